"""Queries of the training-data operators: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostra.llm import consensus, leaks, packing, pairs, sampling, scans, sentences, spans, splitting
from rostra.runtime import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]


def _p1(spark: SparkSession, d: str) -> DataFrame:
    web = table(spark, d, "enriched").filter(F.col("text_origin") == "web")
    return sentences.sentences(web, "speech_id", "speech_text")


def _p3(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_marks(table(spark, d, "enriched"), "speech_id", "speech_text", F.col("text_origin") == "scan")


P8_SQL = "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) > 4096"
P5_SQL = """
SELECT DISTINCT speech_id, 'oversized' AS kind FROM enriched WHERE length(speech_text) > 400
UNION ALL
SELECT DISTINCT speech_id, 'no_boundary' FROM enriched WHERE regexp_matches(speech_text, '[^\\s\\pZ\\pP\\pS]{401}')
"""

# Every window of 200 characters of every document, each once for a document.
_P10_WINDOWS = """w AS (SELECT doc_id, s, substr(text, s + 1, 200) AS g FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS s FROM documents WHERE length(text) >= 200)),
twice AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1)"""
P10_SQL = f"""WITH {_P10_WINDOWS}, m AS (SELECT DISTINCT g, doc_id FROM w WHERE g IN (SELECT g FROM twice))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.g = b.g AND a.doc_id < b.doc_id"""
P10_SHARED_SQL = f"""WITH {_P10_WINDOWS}, s AS (SELECT DISTINCT doc_id, s FROM w WHERE g IN (SELECT g FROM twice)),
o AS (SELECT *, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS step FROM s),
p AS (SELECT doc_id, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) AS spans, sum(CASE WHEN step <= 200 THEN step ELSE 200 END) AS chars FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0)::INT AS n_chars, coalesce(spans, 0)::INT AS spans, coalesce(chars, 0)::BIGINT AS shared_chars,
  round(CASE WHEN length(text) > 0 THEN coalesce(chars, 0) / length(text) ELSE 0 END, 4) AS share FROM documents d LEFT JOIN p USING (doc_id)"""

# Every run of twelve words of documents and items.
P9_SQL = """WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
d AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
t AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw))
SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (r)"""


def _p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each text cover: its length, pieces above the limit, and places where a piece begins behind the last one's end."""
    cut = splitting.split_texts(table(spark, d, "enriched"), "speech_id", "speech_text")
    last = F.lag("end_char").over(Window.partitionBy("uid").orderBy("piece"))
    seen = cut.withColumn("gap", (F.col("start_char") > F.coalesce(last, F.lit(0))).cast("int"))
    size = F.col("end_char") - F.col("start_char")
    whole = seen.groupBy("speech_id", "uid").agg(F.max("end_char").alias("n_chars"), F.sum((size > splitting.LIMIT).cast("int")).alias("over"), F.sum("gap").alias("gaps"))
    return whole.select("speech_id", "n_chars", "over", "gaps").distinct()


P5_COVER_SQL = "SELECT DISTINCT speech_id, length(speech_text)::INT AS n_chars, 0::BIGINT AS over, 0::BIGINT AS gaps FROM enriched WHERE speech_text IS NOT NULL"


def _p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """What the packing holds: documents, tokens, containers above the capacity, documents in pieces that need not be, and
    whether the containers are within a hundredth (and one) of the fewest possible."""
    items = checkpointed(packing.pack(table(spark, d, "documents"), "doc_id", "text"))
    bins = items.filter("size > 0").groupBy("bin").agg(F.sum("size").alias("fill")).agg(
        F.count("*").alias("bins"), F.sum((F.col("fill") > packing.CAPACITY).cast("long")).alias("over"), F.sum("fill").alias("tokens")
    )
    docs = items.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("pieces")).agg(
        F.count("*").alias("docs"), F.sum(((F.col("pieces") > 1) & (F.col("size") <= packing.CAPACITY)).cast("long")).alias("split_small")
    )
    return bins.crossJoin(docs).select("docs", "tokens", "over", "split_small", (F.col("bins") <= F.ceil(F.col("tokens") / packing.CAPACITY) * 1.01 + 1).alias("tight"))


P8_FILL_SQL = "SELECT count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS tokens, 0::BIGINT AS over, 0::BIGINT AS split_small, true AS tight FROM documents WHERE text IS NOT NULL"


def _p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "enriched"), "speech_id", "speech_text", F.col("text_origin") == "scan").drop("uid").distinct()


QUERIES: dict[str, tuple[Query, str | None]] = {
    "p1_found": (_p1, None),
    "p3_found": (_p3, None),
    "p3_paragraphs": (_p3_paragraphs, None),
    "p4_found": (lambda s, d: consensus.found(table(s, d, "extraction")), None),
    "p4_reliability": (lambda s, d: consensus.worth(table(s, d, "extraction")), None),
    "p5_found": (lambda s, d: splitting.oversized(table(s, d, "enriched"), "speech_id", "speech_text"), P5_SQL),
    "p5_pieces": (lambda s, d: splitting.split_texts(table(s, d, "enriched"), "speech_id", "speech_text").drop("uid"), None),
    "p5_cover": (_p5_cover, P5_COVER_SQL),
    "p6_found": (lambda s, d: pairs.found(table(s, d, "call_result")), None),
    "p6_defects": (lambda s, d: pairs.defects(table(s, d, "call_result")).withColumn("p", F.round("p", 4)), None),
    "p7_sample": (lambda s, d: sampling.speech_sample(table(s, d, "meta")), sampling.SQL),
    "p8_found": (lambda s, d: packing.split_keys(table(s, d, "documents"), "doc_id", "text"), P8_SQL),
    "p8_packing": (lambda s, d: packing.pack(table(s, d, "documents"), "doc_id", "text"), None),
    "p8_fill": (_p8_fill, P8_FILL_SQL),
    "p9_found": (lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_items")), P9_SQL),
    "p9_leaks": (lambda s, d: leaks.leaks(table(s, d, "documents"), "doc_id", "text", table(s, d, "eval_items"), "item_id", "text"), None),
    "p10_found": (lambda s, d: spans.found(table(s, d, "documents")), P10_SQL),
    "p10_shared": (lambda s, d: spans.shared_parts(table(s, d, "documents"), "doc_id", "text"), P10_SHARED_SQL),
    "p10_classes": (lambda s, d: spans.classes(table(s, d, "documents"), "doc_id", "text"), None),
}
