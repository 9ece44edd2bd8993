"""Run logs of the annotation grid as JSON lines, and their manifests."""

from __future__ import annotations

import json
import subprocess
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.operators.store import execute, latest, reparsed, same_cell
from rostra.runtime import shared_file, struct

# Fields of a result row.
RESULT = (
    "speech_id long, variant_id string, role string, task string, output_format string, definition string, prompt_hash string, model_id string, family string, "
    "condition string, temperature double, seed long, rep int, mentions_topic boolean, subthemes array<string>, subthemes_raw array<string>, presence_inferred boolean, "
    "evidence_quote string, parse_ok boolean, parse_error string, n_chars_sent int, truncated boolean, prompt_tokens int, completion_tokens int, latency_s double, "
    "attempts int, finish_reason string, error string, raw_text string, reasoning string, ts double, experiment string, run_id string, pool string, code_version string, backend string"
)

# Provenance of rows from before runs were kept apart.
LEGACY = {"experiment": "legacy_pilot", "run_id": "legacy", "code_version": "pre-provenance"}


def read_log(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """Rows of a log with their line; a tolerant read drops blank and corrupt lines, a strict one raises on them.

    What lacks a definition gets the current one.
    """
    if tolerant:
        rows = spark.read.schema(struct(RESULT + ", _corrupt string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        rows = rows.filter("_corrupt is null and not (speech_id is null and prompt_hash is null)").drop("_corrupt")
    else:
        rows = spark.read.schema(struct(RESULT)).option("mode", "FAILFAST").json(path)
    # Ids grow along a file, also where it is read in parts, so they order its lines without a sort.
    rows = rows.withColumns({"source_file": F.col("_metadata.file_path"), "line": F.monotonically_increasing_id()})
    return rows.withColumn("definition", F.coalesce("definition", F.lit("current")))


def read_experiment(spark: SparkSession, root: str, experiment: str) -> DataFrame:
    """Rows of all runs of an experiment, kept as ``root/experiment/run/results.jsonl``; the run is read off the path. Unknown experiments are empty."""
    system, runs = shared_file(spark, f"{root}/{experiment}/*/results.jsonl")
    if not system.globStatus(runs):
        return spark.createDataFrame([], struct(RESULT + ", source_file string, line long"))
    rows = read_log(spark, f"{root}/{experiment}/*/results.jsonl")
    return rows.withColumn("run_id", F.coalesce("run_id", F.regexp_extract("source_file", r"([^/]+)/results\.jsonl", 1)))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a run's folder; each task writes a file of its own."""
    df.write.mode("append").json(path)


def new_run_id() -> str:
    """Id of a run: time and a random tail."""
    return time.strftime("%Y%m%dT%H%M%S", time.gmtime()) + "-" + uuid.uuid4().hex[:6]


def load_experiment(spark: SparkSession, root: str, experiment: str, reparse: bool = True) -> DataFrame:
    """All runs of an experiment as users ask for them: the newest row of each cell, its answer parsed anew."""
    rows = latest(read_experiment(spark, root, experiment))
    return reparsed(rows) if reparse else rows


def stamped(rows: DataFrame, **facts: str) -> DataFrame:
    """Rows with constant provenance columns."""
    return rows.withColumns({name: F.lit(value) for name, value in facts.items()})


def load_legacy(spark: SparkSession, path: str, pilot: DataFrame, spot: DataFrame | None = None, backend: str = "unknown", reparse: bool = True) -> DataFrame:
    """A log from before runs were kept apart, with its provenance: the pool of each row told by who is in which sample.

    ``pilot`` and ``spot`` have speech_id; a row of neither is of an unknown pool.
    """
    rows = read_log(spark, path)
    rows = reparsed(rows) if reparse else rows
    flag = lambda ids, name: ids.select(F.col("speech_id"), F.lit(True).alias(name)).distinct()
    held = rows.drop("pool").join(flag(pilot, "_pilot"), "speech_id", "left")
    held = held.join(flag(spot, "_spot"), "speech_id", "left") if spot is not None else held.withColumn("_spot", F.lit(None).cast("boolean"))
    pooled = held.withColumn("pool", F.when(F.col("_pilot"), "pilot").when(F.col("_spot"), "filter_pool").otherwise("unknown")).drop("_pilot", "_spot")
    return stamped(pooled, backend=backend, **LEGACY)


def write_manifest(path: str, **facts) -> dict:  # noqa: ANN003
    """Facts of a run beside its rows: what was asked and the version of the code, if it is under git."""
    try:
        version = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        version = "unknown"
    manifest = {"written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "code_version": version, **facts}
    spark = SparkSession.active()
    system, target = shared_file(spark, path)
    _, new = shared_file(spark, path + ".tmp")
    out = system.create(new, True)
    out.write(json.dumps(manifest, indent=2, sort_keys=True, default=str).encode())
    out.close()
    system.delete(target, False)
    system.rename(new, target)
    return manifest


def run_grid(cells: DataFrame, root: str, experiment: str, call: Callable[[Mapping], Mapping], done: DataFrame | None = None, tasks: int = 16, **facts) -> str | None:  # noqa: ANN003
    """Run the cells that are not done into a new run of an experiment: its folder, or None where nothing is left to do.

    A run has its manifest and its rows, which carry the run's provenance; ``call`` must not raise. Without ``done`` all
    cells run again, and the newest row of a cell holds.
    """
    left = cells if done is None else cells.join(done, same_cell(cells, done), "left_anti")
    if left.isEmpty():
        return None
    run_id = new_run_id()
    folder = f"{root}/{experiment}/{run_id}"
    manifest = write_manifest(f"{folder}/manifest.json", experiment=experiment, run_id=run_id, **facts)
    given = [f for f in struct(RESULT).fields]

    def one(cell: Mapping) -> dict:
        made = {**cell, **call(cell)}
        return {f.name: made.get(f.name) for f in given}

    rows = stamped(execute(left, one, RESULT, tasks), experiment=experiment, run_id=run_id, code_version=str(manifest["code_version"]))
    rows.write.mode("append").json(f"{folder}/results.jsonl")
    return folder
