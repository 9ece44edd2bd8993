"""The latest result of each cell, kept while run logs grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rostra.operators.store import KEY, latest
from rostra.runtime import shared_file, small_rows, struct
from rostra.sources.logs import RESULT


def stream_logs(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """New rows of run logs as a stream, with event time from ``ts``."""
    rows = spark.readStream.schema(struct(RESULT)).option("maxFilesPerTrigger", files).json(path)
    return rows.withColumn("event_time", F.timestamp_seconds("ts"))


def deduplicated(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows of a stream once for each cell and run, as far as a watermark remembers."""
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark([*KEY, "run_id"])


def keep_latest(rows: DataFrame, target: str, checkpoint: str, buckets: int = 64, once: bool = True) -> StreamingQuery:
    """Fold a stream into a table of the latest row of each cell, kept in buckets by a hash of the cell.

    A batch reads and rewrites only the buckets that its rows fall in, as a new version of each (``bucket=b/v=n``), and then
    drops the versions before the last. A batch that is run again reads the same versions and writes the same, so the table
    stays right if a run breaks off. `read_latest` gives the newest version of every bucket.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
        fresh = batch.drop("event_time").withColumns({"line": F.lit(number).cast("long"), "bucket": place}).persist()
        touched = sorted(r["bucket"] for r in small_rows(fresh.select("bucket").distinct(), buckets, "buckets"))
        held = [(b, v) for b, v in _versions(spark, target) if v < number]
        newest = {b: max(v for c, v in held if c == b) for b, _ in held}
        old = [f"{target}/bucket={b}/v={newest[b]}" for b in touched if b in newest]
        both = fresh
        if old:
            both = fresh.unionByName(spark.read.option("basePath", target).parquet(*old).drop("v"), allowMissingColumns=True)
        whole = latest(both.repartition(buckets, "bucket")).withColumn("v", F.lit(number))
        whole.write.partitionBy("bucket", "v").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
        fresh.unpersist()
        for b, v in held:
            if b in touched and v < newest[b]:
                system, path = shared_file(spark, f"{target}/bucket={b}/v={v}")
                system.delete(path, True)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _versions(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(bucket, version) of a table; at most two versions of each of its buckets stay."""
    system, pattern = shared_file(spark, f"{target}/bucket=*/v=*")
    found = [str(x.getPath().toString()) for x in (system.globStatus(pattern) or [])]
    return [tuple(int(part.split("=")[1]) for part in path.split("/")[-2:]) for path in found]


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The latest row of each cell: the newest version of every bucket."""
    newest: dict[int, int] = {}
    for b, v in _versions(spark, target):
        newest[b] = max(v, newest.get(b, -1))
    return spark.read.option("basePath", target).parquet(*(f"{target}/bucket={b}/v={v}" for b, v in sorted(newest.items()))).drop("bucket", "v")


def counts_by_window(rows: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Calls and failures by model and window of event time, closed by a watermark."""
    return rows.withWatermark("event_time", late).groupBy(F.window("event_time", width), "model_id").agg(
        F.count("*").alias("calls"), F.sum(F.col("error").isNotNull().cast("long")).alias("failed")
    )
