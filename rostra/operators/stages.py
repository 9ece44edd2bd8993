"""Stages of the speaker pipeline that ask an outside service, as joins around a pluggable backend."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostra.functions.text import first_filled, string_list
from rostra.runtime import checkpointed

CALL = "text string, reasoning string, finish_reason string, prompt_tokens int, completion_tokens int, latency_s double, attempts int, error string, raw string"


def unresolved(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is null or blank: what a resumed run still has to do."""
    return df.filter(F.trim(F.coalesce(F.col(column), F.lit(""))) == "")


def overlay(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The base with blanks filled from a fresh table, over the columns of both; rows are matched by the key alone."""
    extra = [c for c in fresh.columns if c not in base.columns]
    both = [c for c in fresh.columns if c in base.columns and c != key]
    other = fresh.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in both), *extra)
    joined = base.join(other, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(*(F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in both else F.col(c) for c in base.columns), *extra)


def with_retries(call: Callable[[str], Mapping], tries: int = 4, base: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], dict]:
    """A call that never raises: it is tried again after growing pauses, and what is left is a record with the error."""

    def run(prompt: str) -> dict:
        began, error = time.perf_counter(), None
        for n in range(1, tries + 1):
            try:
                got = dict(call(prompt))
                return {"reasoning": None, "finish_reason": None, "prompt_tokens": None, "completion_tokens": None, "error": None, "raw": None} | got | {"attempts": n, "latency_s": time.perf_counter() - began}
            except Exception as wrong:  # noqa: BLE001
                error = f"{type(wrong).__name__}: {wrong}"
                if n < tries:
                    sleep(base**n)
        return dict.fromkeys(("text", "reasoning", "finish_reason", "prompt_tokens", "completion_tokens", "raw")) | {"error": error, "attempts": tries, "latency_s": time.perf_counter() - began}

    return run


def ask(df: DataFrame, prompt: Column, backend: Callable[[str], Mapping], tasks: int, key: str) -> DataFrame:
    """Answers (``key`` and the fields of a call) to a prompt column, in ``tasks`` parallel tasks."""
    kind = df.schema[key].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in CALL.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(k, *(answer.get(n) for n in names)) for k, p in zip(batch["k"], batch["p"]) for answer in (backend(p),)]
            yield pd.DataFrame(got, columns=["k", *names])

    return df.select(F.col(key).alias("k"), prompt.alias("p")).repartition(tasks).mapInPandas(run, f"k {kind}, {CALL}").withColumnRenamed("k", key)


def two_candidates(first: Column, second: Column) -> Column:
    """Verdict of two replies: yes as soon as one says so, else uncertain if one is, NA where there was nothing to read, else no."""
    none = first.isNull() & second.isNull()
    return F.when(none, "NA").when(F.coalesce(first == "yes", F.lit(False)) | F.coalesce(second == "yes", F.lit(False)), "yes").when(
        F.coalesce(first == "uncertain", F.lit(False)) | F.coalesce(second == "uncertain", F.lit(False)), "uncertain"
    ).otherwise("no")


def verified_text(own: Column, texts: Column, urls: Column, matched: Column, verdicts: Column) -> Column:
    """Text of a person: their own, else that of the matched link, else of the first link judged yes, else any."""
    place = lambda array, value: F.nullif(F.array_position(array, value), F.lit(0)).cast("int")
    at = lambda i: F.when(i.isNotNull(), F.try_element_at(texts, i))
    return F.coalesce(first_filled(own), at(place(urls, matched)), at(place(verdicts, F.lit("yes"))), F.try_element_at(F.filter(texts, lambda t: F.trim(t) != ""), F.lit(1)))


def allowed_hosts(url: Column, hosts: Sequence[str]) -> Column:
    """Does a link point to one of the hosts?"""
    return F.exists(F.lit(list(hosts)), lambda h: F.contains(url, h))


def first_overlapping(candidates: DataFrame, key: str, order: str, years: str, wanted: str) -> DataFrame:
    """For each key the first candidate in order whose years overlap the wanted ones; both are arrays."""
    near = candidates.filter(F.arrays_overlap(years, wanted))
    return near.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def embedded(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """Unit vectors (``key``, vector) of texts by a pluggable model, in batches; a wrong count of vectors is an error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                got = np.asarray(embed(part["t"].fillna("").tolist()), dtype=float)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                yield pd.DataFrame({"k": part["k"].to_numpy(), "vector": list(got / (np.linalg.norm(got, axis=1, keepdims=True) + 1e-12))})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, vector array<double>").withColumnRenamed("k", key)


def drifted(store: DataFrame, again: DataFrame, key: str, least: float = 0.99) -> DataFrame:
    """Keys whose stored vector is not that of the text any more."""
    from rostra.functions.vectors import cosine

    joined = store.select(key, F.col("vector").alias("old")).join(again.select(key, F.col("vector").alias("new")), key)
    return joined.withColumn("score", cosine(F.col("old"), F.col("new"))).filter(F.col("score") < least).select(key, "score")


def arm(df: DataFrame, **equal) -> DataFrame:  # noqa: ANN003
    """Cells of one arm of a grid: every named column equals its value, or one of its values if that is a list; None means null."""
    for name, value in equal.items():
        df = df.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name).eqNullSafe(F.lit(value)))
    return df


def resumed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a stage that broke off still has to do: rows whose key is not done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def fetched(spark: SparkSession, first: int, last: int, fetch: Callable[[int], tuple[int, str]], tasks: int = 16) -> tuple[DataFrame, DataFrame]:
    """Records of a range of ids, both ends included, from a service: (id, body) and the failed (id, status, note).

    ``fetch`` gives a status and a body; only 200 is a record, 404 is noted as not found, of others the first 200 characters
    are kept, and what it raises becomes the note. Each id is asked once; the answers are written out before they part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                try:
                    status, body = fetch(int(i))
                except Exception as wrong:  # noqa: BLE001
                    status, body = None, f"{type(wrong).__name__}: {wrong}"
                rows.append((i, status, body))
            yield pd.DataFrame(rows, columns=["id", "status", "body"])

    asked = checkpointed(spark.range(first, last + 1, 1, tasks).mapInPandas(run, "id long, status int, body string"))
    note = F.when(F.col("status") == 404, "Not found").when(F.col("status").isNotNull(), F.left("body", F.lit(200))).otherwise(F.col("body"))
    good = F.col("status").eqNullSafe(200)
    return asked.filter(good).select("id", "body"), asked.filter(~good).select("id", "status", note.alias("note"))


def candidate_pages(speakers: DataFrame, key: str, query: Column, links: DataFrame, pages: DataFrame, read: Column, most: int = 2) -> DataFrame:
    """Candidate links and texts of speakers as one row each: (``key``, search_query, links, texts), in the order of the links.

    ``links`` (``key``, place, url) is what a search gave, of which the first ``most`` count; ``pages`` (url, html) what was
    saved; ``read`` turns html into text. A page that was not saved has an empty text, a speaker without links empty lists.
    """
    asked = speakers.select(key, query.alias("search_query"))
    first = links.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).filter(F.col("_n") <= most)
    texts = first.join(pages.select("url", read.alias("text")), "url", "left").select(key, "_n", "url", F.coalesce("text", F.lit("")).alias("text"))
    held = texts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "url", "text"))).alias("_x"))
    none = F.array().cast("array<string>")
    return asked.join(held, key, "left").select(
        key, "search_query", F.coalesce(F.transform("_x", lambda x: x["url"]), none).alias("links"), F.coalesce(F.transform("_x", lambda x: x["text"]), none).alias("texts")
    )


def text_columns(preloaded: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """Two text columns from a list of texts in a cell where it has any, else what was fetched for them."""
    texts = string_list(preloaded)
    have = F.size(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != "")) > 0
    at = lambda i, other: F.when(have, F.coalesce(F.try_element_at(texts, F.lit(i)), F.lit(""))).otherwise(other)
    return at(1, first), at(2, second)


def placed(rows: DataFrame, records: DataFrame, place: str) -> DataFrame:
    """Rows joined to the records of their place, a column of both, as the order of rows is no property of a table."""
    both = [c for c in records.columns if c in rows.columns and c != place]
    return rows.join(records.drop(*both), place, "left")


def members(rows: DataFrame, payloads: DataFrame, key: str, order: str) -> DataFrame:
    """Rows joined to the payload of their member; of several payloads of one member the last in ``order`` holds."""
    fields = [c for c in payloads.columns if c not in (key, order)]
    last = payloads.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_p")).select(key, "_p.*")
    return rows.join(last, key, "left")


def aligned(rows: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the value of their key; rows without one, or with a null one, drop out."""
    return rows.join(values.select(key, value).filter(F.col(value).isNotNull()), key)
