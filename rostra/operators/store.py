"""The result store of an annotation grid: jobs, done cells, latest rows and reparsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions.answers import parsed

KEY = ("speech_id", "prompt_hash", "model_id", "temperature", "seed", "rep")
# Most themes of an answer and least token budget, by task.
CAP, CAP_FREE, BUDGET_FREE = 5, 50, 1024
FREE_TASK = "v1_nocap"


def same_cell(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> Column:
    """Equality of cells in which null equals null."""
    out = F.lit(True)
    for k in key:
        out = out & a[k].eqNullSafe(b[k])
    return out


def jobs(speeches: DataFrame, variants: DataFrame, models: DataFrame, conditions: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Cells to run: speeches x variants x models x conditions x reps, less the cells done.

    Variants, models and conditions are the small dimensions of a plan; ``conditions`` has temperature, seed and reps.
    """
    dims = variants.coalesce(1).crossJoin(models.coalesce(1)).crossJoin(conditions.coalesce(1)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.col("reps") - 1))).drop("reps")
    cells = speeches.crossJoin(F.broadcast(dims))
    return cells if done is None else cells.join(done, same_cell(cells, done), "left_anti")


def done_cells(rows: DataFrame) -> DataFrame:
    """Cells that have a row without an error."""
    return rows.filter("error is null").select(*KEY).distinct()


def latest(rows: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("run_id", "line")) -> DataFrame:
    """The newest row of each cell; null parts of a key are equal."""
    over = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_nth", F.row_number().over(over)).filter("_nth = 1").drop("_nth")


def backfilled(rows: DataFrame) -> DataFrame:
    """Rows with a definition: what lacks one is the current definition."""
    have = F.col("definition") if "definition" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("definition", F.coalesce(have, F.lit("current")))


def theme_cap(task: Column) -> Column:
    """Most themes that an answer of the task may have."""
    return F.when(task == FREE_TASK, CAP_FREE).otherwise(CAP)


def token_budget(task: Column, most: Column, override: Column | None = None) -> Column:
    """Completion budget of a call."""
    rule = F.when(task == FREE_TASK, F.greatest(F.lit(BUDGET_FREE), most)).otherwise(most)
    return rule if override is None else F.coalesce(override, rule)


def reparsed(rows: DataFrame, text: str = "raw_text") -> DataFrame:
    """Rows with verdict and themes parsed anew from the answer; without an answer the row fails with its error."""
    out = rows.withColumn("_p", parsed(F.col(text), F.col("output_format"), theme_cap(F.col("task"))))
    gone = F.col(text).isNull()
    fields = ("mentions_topic", "subthemes", "evidence_quote", "parse_ok", "presence_inferred", "subthemes_raw")
    out = out.withColumns({f: F.col(f"_p.{f}") for f in fields})
    return out.withColumn("parse_error", F.when(gone, F.coalesce("error", F.lit("no text"))).otherwise(F.col("_p.parse_error"))).drop("_p")


def execute(cells: DataFrame, call: Callable[[Mapping], Mapping], ddl: str, tasks: int) -> DataFrame:
    """Run cells through a pluggable backend, a row in and a row out, spread over ``tasks``; the backend must not raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([call(row) for row in batch.to_dict("records")])

    return cells.repartition(tasks).mapInPandas(run, ddl)
