"""Queries that write tables and logs and read them again, and reports over the test tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions import eras
from rostra.operators import metrics, reports, retrieval, stages, store
from rostra.plans import grids
from rostra.plans.core import _ALPHA, _CORE, _decomposition_sql
from rostra.plans.views import ANALYSIS, CELLS, SCORES, cells, scores
from rostra.runtime import checkpointed, scratch, shared_file, table
from rostra.sources import logs, tables
from rostra.streaming import latest as stream

Query = Callable[[SparkSession, str], DataFrame]


def _kept(run: Callable[[SparkSession, str, str], DataFrame]) -> Query:
    """A query with a folder of its own, which goes once its result is written."""
    def query(s: SparkSession, d: str) -> DataFrame:
        folder = scratch(s)
        try:
            return checkpointed(run(s, d, folder))
        finally:
            system, path = shared_file(s, folder)
            system.delete(path, True)

    return query


def _result_rows(s: SparkSession, d: str) -> DataFrame:
    """Calls as rows of a result log."""
    c = table(s, d, "call_result").distinct()
    form = F.when(F.col("prompt_text").contains("JSON"), "json").otherwise("free")
    return c.select(
        "speech_id", F.lit("v").alias("variant_id"), F.lit("none").alias("role"), F.lit("v1").alias("task"), form.alias("output_format"), F.lit("h").alias("prompt_hash"), "model_id", "temperature", "seed",
        F.col("call_id").cast("int").alias("rep"), F.col("text").alias("raw_text"), "finish_reason", "error", "attempts", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"),
    )


def _tolerant(s: SparkSession, d: str, at: str) -> DataFrame:
    rows = _result_rows(s, d)
    bad = s.createDataFrame([("",), ("{broken",), ("[]",), ("{}",)], "value string")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(bad).write.text(f"{at}/log")
    return logs.read_log(s, f"{at}/log").groupBy("model_id", "definition").agg(F.count("*").alias("n"), F.count("raw_text").alias("answers"))


_CALLS = "(SELECT DISTINCT * FROM call_result)"
_TOLERANT = f"SELECT model_id, 'current' AS definition, count(*) AS n, count(text) AS answers FROM {_CALLS} GROUP BY 1"


def _strict(s: SparkSession, d: str, at: str) -> DataFrame:
    logs.append_log(_result_rows(s, d), f"{at}/log")
    logs.append_log(_result_rows(s, d), f"{at}/log")
    return logs.read_log(s, f"{at}/log", tolerant=False).groupBy("model_id").agg(F.count("*").alias("n"), F.count_distinct("source_file", "line").alias("lines"))


def _runs(s: SparkSession, d: str, at: str) -> DataFrame:
    rows = _result_rows(s, d)
    for run, some in (("r1", rows), ("r2", rows.filter("finish_reason = 'stop'"))):
        logs.append_log(some, f"{at}/exp/{run}/results.jsonl")
    found = logs.read_experiment(s, at, "exp")
    none = logs.read_experiment(s, at, "other")
    return found.groupBy("run_id").agg(F.count("*").alias("n")).unionByName(none.agg(F.lit("none").alias("run_id"), F.count("*").alias("n")))


def _newest(s: SparkSession, d: str, at: str) -> DataFrame:
    rows = _result_rows(s, d)
    logs.append_log(rows.withColumn("raw_text", F.lit("Yes.\n- first")).withColumn("output_format", F.lit("free")), f"{at}/exp/r1/results.jsonl")
    logs.append_log(rows.filter("finish_reason = 'stop'").withColumn("raw_text", F.lit("No.")).withColumn("output_format", F.lit("free")), f"{at}/exp/r2/results.jsonl")
    out = logs.load_experiment(s, at, "exp")
    return out.groupBy("model_id", "mentions_topic", F.size("subthemes").alias("themes")).agg(F.count("*").alias("n"))


_KEYS = "k AS (SELECT speech_id, model_id, temperature, seed, call_id, coalesce(bool_or(finish_reason = 'stop'), false) AS again FROM call_result {where} GROUP BY ALL)"


def _legacy(s: SparkSession, d: str, at: str) -> DataFrame:
    logs.append_log(_result_rows(s, d), f"{at}/legacy")
    out = logs.load_legacy(s, f"{at}/legacy", table(s, d, "extraction"), table(s, d, "meta"), backend="host", reparse=False)
    return out.groupBy("pool", "experiment", "run_id", "code_version", "backend").agg(F.count("*").alias("n"))


_LEGACY = f"""SELECT CASE WHEN speech_id IN (SELECT speech_id FROM extraction WHERE speech_id IS NOT NULL) THEN 'pilot' WHEN speech_id IN (SELECT speech_id FROM meta WHERE speech_id IS NOT NULL) THEN 'filter_pool' ELSE 'unknown' END AS pool,
  'legacy_pilot' AS experiment, 'legacy' AS run_id, 'pre-provenance' AS code_version, 'host' AS backend, count(*) AS n FROM {_CALLS} GROUP BY ALL"""


def _stub(cell: Mapping) -> dict:
    """An answer that depends on the cell alone; calls at temperature 0 fail."""
    return {"raw_text": "Yes.\n- a", "error": None if cell["temperature"] else "down", "attempts": 1, "ts": 1.0}


def _grid(s: SparkSession, d: str, at: str) -> DataFrame:
    words = grids.Wording({"none": ""}, {"v1": "Is {{TOPIC}} there?", "v1_nocap": "List {{TOPIC}}."}, {"json": "JSON.", "free": ""}, {"current": "care"}, "v1_nocap")
    plan = grids.default_plan(table(s, d, "calibration_speech").select("speech_id"), words, table(s, d, "model_registry").select("model_id"), "current", (grids.CORE, grids.STOCHASTIC))
    first = logs.run_grid(plan.cells(), at, "exp", _stub, tasks=4)
    done = store.done_cells(logs.read_experiment(s, at, "exp"))
    logs.run_grid(plan.cells(), at, "exp", _stub, done, tasks=4)
    rows = logs.read_experiment(s, at, "exp")
    system, path = shared_file(s, f"{first}/manifest.json")
    said = rows.groupBy("temperature", "pool", "error").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"), F.count_distinct("prompt_hash").alias("prompts"))
    return said.withColumn("manifest", F.lit(bool(system.exists(path))))


_GRID = """WITH c AS (SELECT * FROM (VALUES (0.0::DOUBLE, 'down', 2), (0.7::DOUBLE, NULL, 1)) t(temperature, error, runs))
SELECT temperature, 'pilot' AS pool, error, (SELECT count(*) FROM calibration_speech) * (SELECT count(*) FROM model_registry) * 2 * runs AS n, runs::BIGINT AS runs, 2::BIGINT AS prompts, true AS manifest FROM c"""


def _nothing_left(s: SparkSession, d: str, at: str) -> DataFrame:
    speeches = table(s, d, "calibration_speech").select("speech_id")
    todo = store.jobs(speeches, s.createDataFrame([("h",)], "prompt_hash string"), s.createDataFrame([("m",)], "model_id string"), grids.conditions(s, [grids.REPEATED]).drop("condition"))
    one = logs.run_grid(todo, at, "exp", lambda _: {"raw_text": "No.", "ts": 1.0})
    two = logs.run_grid(todo, at, "exp", lambda _: {"raw_text": "No.", "ts": 1.0}, store.done_cells(logs.read_experiment(s, at, "exp")))
    return logs.read_experiment(s, at, "exp").agg(F.count("*").alias("n"), F.max("rep").alias("last_rep")).withColumns({"ran": F.lit(one is not None), "again": F.lit(two is not None)})


def _compacted(s: SparkSession, d: str, at: str) -> DataFrame:
    table(s, d, "events").repartition(7).write.parquet(f"{at}/many/a")
    table(s, d, "events").limit(0).select("event_id", F.lit("x").alias("extra")).write.parquet(f"{at}/many/b")
    whole = tables.read_many(s, f"{at}/many/*").drop("source_file")
    tables.compact(whole, f"{at}/one", 1, "event_id")
    tables.compact(tables.read_table(s, f"{at}/one"), f"{at}/one", 2, "event_id")
    out = tables.read_many(s, f"{at}/one")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count("extra").alias("extra"))


def _csv(s: SparkSession, d: str, at: str) -> DataFrame:
    p = table(s, d, "speaker_parties_without_url")
    p.select(*(F.col(c).cast("string").alias(c) for c in p.columns)).write.csv(f"{at}/csv", header=True, escape='"', quoteAll=True, nullValue="", emptyValue="")
    back = tables.read_strings(s, f"{at}/csv", ["gender"])
    return back.groupBy("start_year").agg(F.count("*").alias("n"), F.count("gender").alias("genders"), F.count_distinct("speaker_name").alias("speakers"))


def _resumed(s: SparkSession, d: str, at: str) -> DataFrame:
    rows = table(s, d, "enriched").filter("speech_id is not null")
    speeches = rows.select("speech_id").distinct()
    rows.filter("text_origin = 'scan'").select("speech_id").distinct().write.parquet(f"{at}/done")
    left = stages.resumed(speeches, tables.read_table(s, f"{at}/done"), "speech_id")
    left.write.mode("append").parquet(f"{at}/done")
    return tables.read_table(s, f"{at}/done").agg(F.count("*").alias("n"), F.count_distinct("speech_id").alias("ids")).withColumn("left", F.lit(stages.resumed(speeches, tables.read_table(s, f"{at}/done"), "speech_id").count()))


def _manifest(s: SparkSession, _: str, at: str) -> DataFrame:
    logs.write_manifest(f"{at}/m/manifest.json", experiment="old", n=1)
    logs.write_manifest(f"{at}/m/manifest.json", experiment="exp", n=2)
    return s.read.json(f"{at}/m/manifest.json", multiLine=True).select("experiment", "n", (F.col("written_at").rlike(r"^\d{4}-\d\d-\d\dT") & F.col("code_version").isNotNull()).alias("dated"))


def _store(s: SparkSession, d: str, at: str) -> DataFrame:
    def embed(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), 1.0] for t in texts])

    docs = table(s, d, "documents")
    wanted = docs.select(retrieval.vector_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    retrieval.ensured(docs.filter("lang = 'en'").select(retrieval.vector_key(F.col("doc_id"), F.col("text")).alias("key"), "text"), f"{at}/v", embed)
    out = retrieval.ensured(wanted, f"{at}/v", embed)
    kept = s.read.parquet(f"{at}/v")
    total = kept.agg(F.count("*").alias("stored"), F.count_distinct("key").alias("keys"))
    n = out.select((F.size("vector") == 2).alias("two"), F.size(F.split("key", r"\|")).alias("parts")).groupBy("two", "parts").agg(F.count("*").alias("n"))
    return n.crossJoin(total)


def _streamed(s: SparkSession, d: str, at: str) -> DataFrame:
    rows = _result_rows(s, d).filter("ts is not null")
    logs.append_log(rows.coalesce(1), f"{at}/in")
    logs.append_log(rows.filter("finish_reason = 'stop'").withColumn("run_id", F.lit("r2")).withColumn("raw_text", F.lit("late")).coalesce(1), f"{at}/in")
    stream.keep_latest(stream.stream_logs(s, f"{at}/in"), f"{at}/out", f"{at}/ck", buckets=8).awaitTermination()
    return stream.read_latest(s, f"{at}/out").groupBy("model_id", F.col("raw_text").eqNullSafe("late").alias("late")).agg(F.count("*").alias("n"))


def _windows(s: SparkSession, d: str, at: str) -> DataFrame:
    rows = _result_rows(s, d).filter("ts is not null").withColumn("run_id", F.lit("r1"))
    logs.append_log(rows, f"{at}/in")
    live = stream.counts_by_window(stream.deduplicated(stream.stream_logs(s, f"{at}/in"), "36500 days"), "1 day", "36500 days")
    name = f"w_{at[-12:]}"
    live.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{at}/ck").start().awaitTermination()
    return s.table(name).select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "model_id", "calls", "failed")


def _rates(s: SparkSession, d: str) -> DataFrame:
    year = F.lit(1803) + F.col("speech_id") * 7919 % 223
    return cells(s, d).withColumn("era", eras.era_of(year)).groupBy("definition", "era").agg(F.avg(F.col("mentions_topic").cast("double")).alias("rate"))


_RATES = f"rate AS (SELECT definition, {ANALYSIS} AS era, avg(mentions_topic::INT) AS rate FROM (SELECT *, 1803 + speech_id * 7919 % 223 AS year FROM cell) GROUP BY 1, 2)"


def _split_rates(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).groupBy("speech_id", "definition").agg(F.round(F.avg(F.col("mentions_topic").cast("double")), 9).alias("rate"))


def _cap_order(s: SparkSession, d: str) -> DataFrame:
    effect = metrics.cap_effect(cells(s, d), ["model_id", "output_format"], "task", "v1", "v1_nocap", "n_sub")
    every = cells(s, d).select("speech_id").distinct().join(effect, "speech_id", "left")
    return reports.effect_order(every, "cap_effect", "speech_id").select("rank", "speech_id", "cap_effect")


def _ap_order(s: SparkSession, d: str) -> DataFrame:
    ranked = metrics.ranking(scores(s, d), ["query_id"], "score", "relevant").withColumn("mode", F.lit("whole"))
    return reports.ranked_results(ranked).select("rank", "query_id", "mode", "ap")


def _report(s: SparkSession, d: str) -> DataFrame:
    said = table(s, d, "model_registry").groupBy("family").agg(F.count("*").alias("n")).orderBy("family")
    return s.createDataFrame([(reports.markdown(said, "Families"), reports.payload(said))], "page string, payload string")


_REPORT = """WITH f AS (SELECT family, count(*) AS n FROM model_registry GROUP BY 1)
SELECT '## Families' || chr(10) || chr(10) || '| family | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || family || ' | ' || n || ' |', chr(10) ORDER BY family) || chr(10) AS page,
  '[' || string_agg('{"family": "' || family || '", "n": ' || n || '}', ', ' ORDER BY family) || ']' AS payload FROM f"""


def _explorer(s: SparkSession, d: str) -> DataFrame:
    speeches = table(s, d, "enriched").groupBy("speech_id").agg(F.max("year").alias("year"), F.max("section_title").alias("section_title"), F.max("speech_text").alias("speech_text"))
    marks = table(s, d, "extraction").select("speech_id", "model_id", "mentions_topic").distinct()
    out = reports.explorer(speeches, marks)
    return out.select("speech_id", "year", F.length("excerpt").alias("chars"), F.size("cells").alias("cells"))


def _headline(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d)
    return reports.headline(c, c.filter("condition = 'temp07'"), metrics.core_grid(c)).withColumn("value", F.round("value", 4))


def _headline_sql() -> str:
    alpha = lambda unit, source: _ALPHA.format(g="", u=unit, r="mentions_topic", t=source, by="")
    rows = lambda section, names, source: " UNION ALL ".join(f"SELECT '{section}' AS section, '{n}' AS name, round({n}::DOUBLE, 4) AS value FROM {source}" for n in names)
    factors = _decomposition_sql().split(f"{_CORE} ", 1)[1]
    return f"""WITH {CELLS}, {_CORE}, hot AS (SELECT * FROM cell WHERE condition = 'temp07'), pres AS (WITH {alpha('speech_id', 'core')}), again AS (WITH {alpha('speech_id, role, task, definition, model_id', 'hot')}),
    pr AS (SELECT avg(mentions_topic::INT) AS p FROM core GROUP BY role, task, output_format, model_id), sp AS (SELECT avg(p) AS mean, min(p) AS min, max(p) AS max, max(p) - min(p) AS spread FROM pr WHERE p IS NOT NULL), fa AS ({factors})
    {rows('presence', ('alpha', 'mean_pairwise_agreement', 'units'), 'pres')} UNION ALL SELECT 'factor', factor, round(disagreement, 4) FROM fa UNION ALL {rows('self-consistency', ('alpha', 'units'), 'again')} UNION ALL {rows('prevalence', ('mean', 'min', 'max', 'spread'), 'sp')}"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "src1_scan": (
        lambda s, d: tables.read_table(s, f"{d}/enriched.parquet").groupBy("text_origin").agg(F.count("*").alias("n"), F.count_distinct("speech_id").alias("speeches")),
        "SELECT text_origin, count(*) AS n, count(DISTINCT speech_id) AS speeches FROM enriched GROUP BY 1",
    ),
    "src3_compacted": (_kept(_compacted), "SELECT event_type, count(*) AS n, 0::BIGINT AS extra FROM events GROUP BY 1"),
    "src4_tolerant": (_kept(_tolerant), _TOLERANT),
    "src5_strict": (_kept(_strict), f"SELECT model_id, 2 * count(*) AS n, 2 * count(*) AS lines FROM {_CALLS} GROUP BY 1"),
    "src6_runs": (_kept(_runs), f"SELECT 'r1' AS run_id, count(*) AS n FROM {_CALLS} UNION ALL SELECT 'r2', count(*) FROM {_CALLS} WHERE finish_reason = 'stop' UNION ALL SELECT 'none', 0"),
    "src8_csv": (_kept(_csv), "SELECT start_year::VARCHAR AS start_year, count(*) AS n, 0::BIGINT AS genders, count(DISTINCT speaker_name) AS speakers FROM speaker_parties_without_url GROUP BY 1"),
    "snk3_resumed": (_kept(_resumed), "SELECT count(DISTINCT speech_id) AS n, count(DISTINCT speech_id) AS ids, 0 AS left FROM enriched"),
    "snk4_manifest": (_kept(_manifest), "SELECT 'exp' AS experiment, 2::BIGINT AS n, true AS dated"),
    "snk6_report": (_report, _REPORT),
    "snk7_explorer": (
        _explorer,
        """WITH e AS (SELECT speech_id, max(year) AS year, max(speech_text) AS t FROM enriched GROUP BY 1), m AS (SELECT speech_id, count(*) AS cells FROM (SELECT DISTINCT speech_id, model_id, mentions_topic FROM extraction) GROUP BY 1)
        SELECT e.speech_id, year, length(left(coalesce(t, ''), 400))::INT AS chars, cells::INT AS cells FROM e JOIN m ON e.speech_id = m.speech_id""",
    ),
    "sto5_run": (_kept(_grid), _GRID),
    "sto5_nothing_left": (_kept(_nothing_left), "SELECT 3 * count(*) AS n, 2 AS last_rep, true AS ran, false AS again FROM calibration_speech"),
    "sto8_experiment": (
        _kept(_newest),
        f"WITH {_KEYS.format(where='')} SELECT model_id, NOT again AS mentions_topic, CASE WHEN again THEN 0 ELSE 1 END AS themes, count(*) AS n FROM k GROUP BY 1, 2, 3",
    ),
    "sto9_legacy": (_kept(_legacy), _LEGACY),
    "vec7_store": (
        _kept(_store),
        "WITH k AS (SELECT DISTINCT doc_id, text FROM documents) SELECT true AS two, 3 AS parts, count(*) AS n, count(*) AS stored, count(*) AS keys FROM k",
    ),
    "stream_latest": (
        _kept(_streamed),
        f"WITH {_KEYS.format(where='WHERE ts IS NOT NULL')} SELECT model_id, again AS late, count(*) AS n FROM k GROUP BY 1, 2",
    ),
    "stream_windows": (
        _kept(_windows),
        """WITH k AS (SELECT speech_id, model_id, temperature, seed, call_id, min(ts) AS ts, max(error) AS error FROM call_result WHERE ts IS NOT NULL GROUP BY ALL)
        SELECT strftime(ts, '%Y-%m-%d') AS day, model_id, count(*) AS calls, count(error) AS failed FROM k GROUP BY 1, 2""",
    ),
    "agg11_wide": (
        lambda s, d: reports.wide(scores(s, d).withColumn("model", F.concat(F.lit("q"), "query_id")), "vec_id", "model", "score", [f"q{i}" for i in range(10)]),
        f"WITH {SCORES} SELECT vec_id, " + ", ".join(f"max(score) FILTER (query_id = {i}) AS q{i}" for i in range(10)) + " FROM score GROUP BY 1",
    ),
    "agg22_gradient": (
        lambda s, d: reports.gradient(_rates(s, d), ["definition"], "era", "rate", "pre-1900", "post-1948"),
        f"WITH {CELLS}, {_RATES} SELECT definition, round(max(rate) FILTER (era = 'post-1948') - max(rate) FILTER (era = 'pre-1900'), 6) AS gradient FROM rate GROUP BY 1",
    ),
    "agg23_masked": (
        lambda s, d: metrics.masked_rate(cells(s, d), ["output_format"], F.col("n_sub") > 3).unionByName(metrics.masked_rate(cells(s, d), ["output_format"])),
        f"""WITH {CELLS} SELECT output_format, sum((n_sub > 3)::INT)::BIGINT AS positives, count(*) AS parsed, round(sum((n_sub > 3)::INT) / count(*), 6) AS share FROM cell WHERE parse_ok GROUP BY 1
        UNION ALL SELECT output_format, sum(coalesce(mentions_topic, false)::INT)::BIGINT, count(*), round(sum(coalesce(mentions_topic, false)::INT) / count(*), 6) FROM cell WHERE parse_ok GROUP BY 1""",
    ),
    "top3_results": (
        _ap_order,
        f"""WITH {SCORES}, g AS (SELECT query_id, score, count(*) AS n, sum(relevant) AS tp FROM score GROUP BY 1, 2),
        r AS (SELECT *, sum(tp) OVER d AS ctp, sum(n) OVER d AS cn, sum(tp) OVER (PARTITION BY query_id) AS p, sum(n) OVER (PARTITION BY query_id) - sum(tp) OVER (PARTITION BY query_id) AS q FROM g WINDOW d AS (PARTITION BY query_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
        a AS (SELECT query_id, round(sum(tp / p * ctp / cn), 6) AS ap FROM r WHERE p > 0 AND q > 0 GROUP BY query_id) SELECT row_number() OVER (ORDER BY ap DESC, query_id) AS rank, query_id, 'whole' AS mode, ap FROM a""",
    ),
    "top6_cap_order": (
        _cap_order,
        f"""WITH {CELLS}, x AS (SELECT speech_id, model_id, output_format, avg(n_sub) FILTER (task = 'v1') AS c, avg(n_sub) FILTER (task = 'v1_nocap') AS u FROM cell WHERE task IN ('v1', 'v1_nocap') GROUP BY ALL),
        e AS (SELECT speech_id, round(avg(c - u), 6) AS cap_effect FROM x WHERE c IS NOT NULL AND u IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT speech_id FROM cell)
        SELECT row_number() OVER (ORDER BY cap_effect DESC NULLS LAST, speech_id) AS rank, speech_id, cap_effect FROM k LEFT JOIN e USING (speech_id)""",
    ),
    "top7_contested": (
        lambda s, d: reports.contested(_split_rates(s, d), "speech_id", "definition", "rate", "current", "expert"),
        f"""WITH {CELLS}, r AS (SELECT speech_id, definition, round(avg(mentions_topic::INT), 9) AS rate FROM cell GROUP BY 1, 2),
        b AS (SELECT speech_id, max(rate) FILTER (definition = 'current') AS one, max(rate) FILTER (definition = 'expert') AS other FROM r GROUP BY 1)
        SELECT speech_id, round(abs(other - one), 6) AS gap, one, other FROM b WHERE round(abs(other - one), 6) > 0""",
    ),
    "join6_aligned": (
        lambda s, d: stages.aligned(table(s, d, "meta").select("speech_id").distinct(), metrics.gold(table(s, d, "extraction"), 1), "speech_id", "rate"),
        "WITH g AS (SELECT speech_id, round(avg(mentions_topic::INT), 6) AS rate FROM extraction WHERE mentions_topic IS NOT NULL GROUP BY 1) SELECT speech_id, rate FROM (SELECT DISTINCT speech_id FROM meta) JOIN g USING (speech_id)",
    ),
    "lim1_trial": (
        lambda s, d: grids.first_speeches(table(s, d, "meta").select("speech_id").filter("speech_id is not null").distinct(), "speech_id", 25),
        "SELECT DISTINCT speech_id FROM meta WHERE speech_id IS NOT NULL ORDER BY speech_id LIMIT 25",
    ),
    "prj2_stamped": (
        lambda s, d: logs.stamped(table(s, d, "model_registry").select("model_id"), pool="pilot", experiment="exp"),
        "SELECT model_id, 'pilot' AS pool, 'exp' AS experiment FROM model_registry",
    ),
    "met21_headline": (_headline, _headline_sql()),
}
