"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct(ddl: str) -> StructType:
    """The schema of a DDL string."""
    return _parse_datatype_string(ddl)


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """Apply ``rows`` to a partition's rows as tuples, through Arrow batches in both directions.

    ``rows`` gets an iterator over one batch and returns tuples in the order of ``ddl``; it is called once for each
    batch, so it may keep statistics of a batch and emit them at its end (a partial aggregate).
    """
    schema = struct(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = list(rows(zip(*(c.to_pylist() for c in batch.columns))))
            for at in range(0, len(out), 50_000):
                part = out[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _own_folder() -> str:
    """A temporary folder that goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="rostra-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Without one, a session in one process gets a temporary folder; on a cluster that would lose data, so it is an error.
    Checkpoints are removed with the tables that refer to them where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or _own_folder())
    return df.checkpoint()


def shared_file(spark: SparkSession, path: str):  # noqa: ANN201
    """A path on whatever file system the session reads: (file system, path)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, for tables that a query writes and reads again."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"


def small_rows(df: DataFrame, bound: int, what: str) -> list:
    """Rows of a result whose size is bounded by its definition; raises if the bound does not hold."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows")
    return rows


def sized(df: DataFrame, bound: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``bound`` rows; joined by shuffle beyond."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
