"""Derived views over the test tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostra.functions.eras import ANALYSIS_ERAS, SAMPLING_ERAS, decade_of, era_of, era_sql
from rostra.functions.text import SEED, seed_present
from rostra.functions.vectors import cosine
from rostra.runtime import table

TIERS = ("short", "medium", "long")
CHAMBERS = ("Commons", "Lords")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Speeches that pass the hygiene filters, without their text: id, strata and length, once for each speech."""
    rows = table(spark, d, "enriched").filter(
        F.col("speech_text").isNotNull() & ~F.col("procedural") & (F.col("word_count") >= 40) & F.col("speech_type").isin(*TIERS)
        & F.col("chamber").isin(*CHAMBERS) & F.col("year").isNotNull()
    )
    flagged = rows.select("speech_id", "year", "speech_type", "word_count", seed_present(F.col("speech_text")).alias("seed_present"))
    flagged = flagged.groupBy("speech_id").agg(F.min(F.struct("year", "speech_type", "word_count", "seed_present")).alias("s")).select("speech_id", "s.*")
    return flagged.withColumns({"era": era_of(F.col("year"), SAMPLING_ERAS), "decade_bin": decade_of(F.col("year"))})


_SEED = SEED.replace("'", "''")
CANDIDATES = f"""cand0 AS (
  SELECT speech_id, year, speech_type, word_count, regexp_matches(lower(speech_text), '{_SEED}') AS seed_present,
    row_number() OVER (PARTITION BY speech_id ORDER BY year, speech_type, word_count, regexp_matches(lower(speech_text), '{_SEED}')) AS nth
  FROM enriched
  WHERE speech_text IS NOT NULL AND NOT procedural AND word_count >= 40 AND speech_type IN ('short', 'medium', 'long') AND chamber IN ('Commons', 'Lords') AND year IS NOT NULL
), cand AS (
  SELECT speech_id, year, speech_type, word_count, seed_present, {era_sql('year', SAMPLING_ERAS)} AS era, CAST(floor(year / 10) * 10 AS INT) AS decade_bin FROM cand0 WHERE nth = 1
)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Events as cells of an annotation grid."""
    e = table(spark, d, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    e = e.select(
        F.col("user_id").alias("speech_id"), F.col("event_type").alias("model_id"), k.alias("k"), "value", "ts", F.col("event_id").alias("ord"),
        F.when(F.col("event_id") % 23 != 0, F.col("value") > 35).alias("mentions_topic"), F.when(F.col("event_id") % 5 == 0, "temp07").otherwise("temp0").alias("condition"),
    )
    pick = lambda c, *names: F.element_at(F.lit(list(names)), (c + 1).cast("int"))
    third = lambda n, m: F.floor(F.col("k") / n) % m
    out = e.select(
        "speech_id", "model_id", "condition", "mentions_topic", "ts", "ord", "value", pick(F.col("k") % 2, "json", "free").alias("output_format"), pick(third(2, 3), "v1", "v1_nocap", "v2").alias("task"),
        pick(third(6, 2), "reader", "historian").alias("role"), pick(third(12, 4), "current", "expert", "era_neutral", "name_only").alias("definition"),
        (F.floor("value").cast("int") % 8).alias("n_sub"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("mentions_topic").isNotNull().alias("parse_ok"),
        ((F.col("k") % 2 == 1) & (F.col("ord") % 7 == 0)).alias("presence_inferred"),
    )
    rep = Window.partitionBy("speech_id", "model_id", "output_format", "task", "role", "definition", "condition").orderBy("ord")
    return out.withColumn("rep", F.row_number().over(rep) - 1)


CELLS = """cell0 AS (
  SELECT user_id AS speech_id, event_type AS model_id, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, value, ts, event_id AS ord,
    CASE WHEN event_id % 23 <> 0 THEN value > 35 END AS mentions_topic, CASE WHEN event_id % 5 = 0 THEN 'temp07' ELSE 'temp0' END AS condition
  FROM events
), cell1 AS (
  SELECT speech_id, model_id, condition, mentions_topic, ts, ord, value, CASE k % 2 WHEN 0 THEN 'json' ELSE 'free' END AS output_format,
    CASE (k // 2) % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v1_nocap' ELSE 'v2' END AS task, CASE (k // 6) % 2 WHEN 0 THEN 'reader' ELSE 'historian' END AS role,
    CASE (k // 12) % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'expert' WHEN 2 THEN 'era_neutral' ELSE 'name_only' END AS definition,
    CAST(floor(value) AS INT) % 8 AS n_sub, strftime(ts, '%Y-%m-%d') AS run_id, mentions_topic IS NOT NULL AS parse_ok, (k % 2 = 1 AND ord % 7 = 0) AS presence_inferred
  FROM cell0
), cell AS (
  SELECT *, row_number() OVER (PARTITION BY speech_id, model_id, output_format, task, role, definition, condition ORDER BY ord) - 1 AS rep FROM cell1
)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with one query vector for each label; relevant are the vectors of the label."""
    v = table(spark, d, "embeddings")
    q = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qv")).select(F.col("label").alias("query_id"), "qv")
    s = v.crossJoin(F.broadcast(q)).select("vec_id", "query_id", F.round(cosine(F.col("embedding"), F.col("qv")), 9).alias("score"), (F.col("label") == F.col("query_id")).cast("int").alias("relevant"))
    return s


SCORES = """qry AS (
  SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings GROUP BY label
), score AS (
  SELECT vec_id, query_id, CAST(label = query_id AS INT) AS relevant,
    round(list_inner_product(embedding::DOUBLE[], qv) / ((sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12) * (sqrt(list_inner_product(qv, qv)) + 1e-12)), 9) AS score
  FROM embeddings, qry
)"""

ANALYSIS = era_sql("year", ANALYSIS_ERAS)
