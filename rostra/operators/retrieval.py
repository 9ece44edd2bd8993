"""Scoring of documents against a small set of queries, whole or by chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.text import CHUNK, OVERLAP, chunk_units, content_hash, pack_units
from rostra.functions.vectors import cosine
from rostra.operators.stages import embedded
from rostra.runtime import map_rows, shared_file, struct

#: Most queries that are sent to every task with the documents.
QUERIES = 10_000


def chunk_rows(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Sentence-packed chunks of every text: (``key``, chunk_ix, chunk). Null and empty texts have none; no text is lost."""
    kind = df.schema[key].dataType.simpleString()

    def pack(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, units in rows:
            for i, chunk in enumerate(pack_units(units, size, overlap)):
                yield (k, i, chunk)

    units = df.select(F.col(key).alias("k"), chunk_units(F.col(text), size, overlap).alias("units"))
    return map_rows(units, pack, f"k {kind}, chunk_ix int, chunk string").withColumnRenamed("k", key)


def dense_scores(docs: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str = "query_id", query_vector: str = "query_vec") -> DataFrame:
    """Cosine of every document with every query, the queries a stated set whose size is checked."""
    if queries.limit(QUERIES + 1).count() > QUERIES:
        # Beyond the bound, both sides meet by blocks of queries instead of a broadcast.
        blocks = queries.withColumn("block", F.pmod(F.xxhash64(query_key), F.lit(64)))
        spread = docs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<long>")))
        return spread.join(blocks, "block").drop("block").withColumn("score", cosine(F.col(vector), F.col(query_vector))).drop(vector, query_vector)
    return docs.crossJoin(F.broadcast(queries)).withColumn("score", cosine(F.col(vector), F.col(query_vector))).drop(vector, query_vector)


def best_chunk(scores: DataFrame, key: str, query_key: str = "query_id") -> DataFrame:
    """The best chunk's score of each document; documents without chunks are left out."""
    return scores.groupBy(key, query_key).agg(F.max("score").alias("score"))


def pooled_chunks(docs: DataFrame, queries: DataFrame, scores: DataFrame, key: str, query_key: str = "query_id") -> DataFrame:
    """Best and mean chunk score for every document and query, 0 where a document has no chunk."""
    pairs = docs.select(key).crossJoin(F.broadcast(queries.select(query_key)))
    pooled = scores.groupBy(key, query_key).agg(F.max("score").alias("best"), F.avg("score").alias("mean"))
    return pairs.join(pooled, [key, query_key], "left").select(key, query_key, F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def missing(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows whose vector the store lacks: what is still to be embedded."""
    return wanted.join(store.select(key).distinct(), key, "left_anti")


def vector_key(key: Column, text: Column, scheme: Column | str = "whole") -> Column:
    """Key of a stored vector: whose it is, the hash of its text and the scheme that made it, so that a changed text is a new key."""
    return F.concat_ws("|", key.cast("string"), content_hash(F.coalesce(text, F.lit(""))), F.lit(scheme) if isinstance(scheme, str) else scheme)


def ensured(wanted: DataFrame, path: str, embed: Callable[[list[str]], np.ndarray], key: str = "key", text: str = "text") -> DataFrame:
    """Vectors (``key``, vector) of the wanted texts from a store of vectors; what the store lacks is embedded and appended.

    A blank text is embedded as one blank. Each missing key is embedded once, by a model that is pluggable, and is on the
    store before it is used, so a run that breaks off keeps what it has.
    """
    spark = wanted.sparkSession
    system, place = shared_file(spark, path)
    store = (lambda: spark.read.parquet(path)) if system.exists(place) else (lambda: spark.createDataFrame([], struct("key string, vector array<double>")))
    asked = wanted.select(F.col(key).alias("key"), F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", " ").otherwise(F.col(text)).alias("text")).filter("key is not null")
    todo = missing(asked.dropDuplicates(["key"]), store(), "key")
    embedded(todo, "key", "text", embed).write.mode("append").parquet(path)
    return asked.select("key").distinct().join(spark.read.parquet(path), "key").withColumnRenamed("key", key)
