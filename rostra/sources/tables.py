"""Tables: Parquet, CSV and JSON readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.runtime import shared_file


def read_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """Parquet table, as a view too if one is named; FileNotFoundError where there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as wrong:
        if "PATH_NOT_FOUND" in str(wrong):
            raise FileNotFoundError(path) from wrong
        raise
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_many(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet files of a pattern with their schemas merged and the file they came from."""
    return spark.read.option("mergeSchema", "true").parquet(pattern).withColumn("source_file", F.col("_metadata.file_path"))


def read_strings(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """CSV with every value a string; named columns that the file lacks are added as nulls."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def compact(df: DataFrame, path: str, files: int, key: str | None = None) -> None:
    """Write a table of many small files as a few and put it in the place of the old one once it is proven whole.

    The new table is written beside the place, then its rows, and its keys if one is named, are counted against ``df``;
    only then does it take the place. A table that is not whole is an error, and the old one stays.
    """
    spark = df.sparkSession
    df.coalesce(files).write.mode("overwrite").parquet(path + ".new")
    facts = lambda t: t.agg(F.count("*").alias("rows"), (F.count_distinct(key) if key else F.lit(0)).alias("keys")).first()
    have, want = facts(spark.read.parquet(path + ".new")), facts(df)
    if have != want:
        raise ValueError(f"{path}: {have} written, {want} expected")
    system, place = shared_file(spark, path)
    _, new = shared_file(spark, path + ".new")
    _, old = shared_file(spark, path + ".old")
    system.delete(old, True)
    if system.exists(place):
        system.rename(place, old)
    if not system.rename(new, place):
        raise OSError(f"{path}: the new table could not take its place")
    system.delete(old, True)
