"""Further core queries: joins, sets, aggregates, scalars and reports of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions import answers, text
from rostra.functions.vectors import hashed_embedding
from rostra.operators import metrics, reports, stages
from rostra.plans import grids
from rostra.plans.views import CELLS, SCORES, cells, scores
from rostra.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
_ARM = "condition = 'temp0' AND output_format = 'json' AND task = 'v1' AND definition = 'current'"


def _pool_labels(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "enriched").select("speech_id").distinct()
    pilot = table(s, d, "extraction").select("speech_id", F.lit(True).alias("p")).distinct()
    pool = table(s, d, "meta").select("speech_id", F.lit(True).alias("f")).distinct()
    label = F.when(F.col("p"), "pilot").when(F.col("f"), "filter_pool").otherwise("unknown")
    return ids.join(pilot, "speech_id", "left").join(pool, "speech_id", "left").select("speech_id", label.alias("pool"))


def _null_cells(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "meta").select("speech_id", "era", "seed_present").distinct()
    n = m.groupBy(F.col("era").alias("e"), F.col("seed_present").alias("p")).agg(F.count("*").alias("cell_pop"))
    return m.join(n, m.era.eqNullSafe(n.e) & m.seed_present.eqNullSafe(n.p)).select("speech_id", "era", "seed_present", "cell_pop")


def _cell_pairs(s: SparkSession, d: str) -> DataFrame:
    c = metrics.core_grid(cells(s, d)).select("speech_id", F.concat_ws("|", "role", "task", "output_format", "model_id").alias("cell")).distinct()
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.speech_id") == F.col("b.speech_id")) & (F.col("a.cell") < F.col("b.cell")))
    return pairs.groupBy(F.col("a.speech_id").alias("speech_id")).agg(F.count("*").alias("pairs"))


def _sets(s: SparkSession, d: str) -> DataFrame:
    e, m, x = (table(s, d, t).select("speech_id").filter("speech_id is not null").distinct() for t in ("enriched", "meta", "extraction"))
    size = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    out = size(e.join(m, "speech_id", "left_semi"), "enriched and meta")
    for df, name in ((e.join(m, "speech_id", "left_anti"), "enriched less meta"), (e.unionByName(m).unionByName(x).distinct(), "any"), (m.intersect(x), "meta and extraction"), (x.exceptAll(m), "extraction less meta")):
        out = out.unionByName(size(df, name))
    return out


def _first_verdicts(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).groupBy("speech_id", "model_id").agg(F.min_by("mentions_topic", F.when(F.col("mentions_topic").isNotNull(), F.col("ord"))).alias("first"), F.max("ord").alias("last"))


def _spellings(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "speaker_parties_without_url").filter("trim(party) <> ''")
    return rows.groupBy(F.lower(F.trim("party")).alias("party")).agg(F.array_join(F.array_sort(F.collect_set("party")), "; ").alias("spellings"), F.countDistinct("speaker_name").alias("speakers"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy("source").agg(F.min("sitting_date").alias("first"), F.max("sitting_date").alias("last"), F.count("*").alias("n")).select("source", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n", F.datediff("last", "first").alias("gap_days"))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "speaker_parties_without_url")
    as_text = lambda c: F.col(c).cast("string")
    prof = text.profile_text({"Name": F.col("speaker_name"), "Party": F.col("party"), "From": as_text("start_year")})
    return p.select("speaker_name", prof.alias("profile"), text.service_span(as_text("start_year"), as_text("end_year")).alias("span"), text.whole_date(as_text("start_year")).alias("start"), text.year_of(as_text("end_year")).alias("end_year")).distinct()


_PROFILES = """SELECT DISTINCT speaker_name, concat_ws(chr(10), CASE WHEN trim(speaker_name) <> '' THEN 'Name: ' || speaker_name END, CASE WHEN trim(party) <> '' THEN 'Party: ' || party END, CASE WHEN start_year IS NOT NULL THEN 'From: ' || start_year END) AS profile,
  left(start_year::VARCHAR, 4) || ' to ' || coalesce(left(end_year::VARCHAR, 4), 'present') AS span, CASE WHEN start_year BETWEEN 1000 AND 2026 THEN start_year || '-01-01' ELSE '' END AS start,
  CASE WHEN end_year BETWEEN 1000 AND 2031 THEN end_year END AS end_year FROM speaker_parties_without_url"""

_ROLES, _TASKS = {"none": "", "expert": "You know {{TOPIC}} well."}, {"v1": "Does it mention {{TOPIC}}?", "v2": "Is {{TOPIC}} discussed?"}
_FORMATS, _TOPICS = {"json": "Answer in JSON.", "free": ""}, {"current": "health", "expert": "health and social care"}


def _prompts(s: SparkSession, d: str) -> DataFrame:
    v = grids.variants(s, _ROLES, _TASKS, _FORMATS, _TOPICS).select("variant_id", "definition", "prompt_hash", "user")
    speeches = table(s, d, "calibration_speech")
    return speeches.crossJoin(F.broadcast(v)).select("speech_id", "variant_id", "definition", "prompt_hash", F.md5(grids.rendered(F.col("user"), F.col("speech_text"))).alias("digest"))


def _values(name: str, rows: dict[str, str]) -> str:
    return f"(VALUES {', '.join(f'({k!r}, {v!r})' for k, v in rows.items())}) {name}({name}, {name}_text)"


_PROMPTS = f"""WITH g AS (SELECT role, role_text, task, fmt, definition, replace(task_text, '{{{{TOPIC}}}}', definition_text) || chr(10) || chr(10) || CASE WHEN fmt_text <> '' THEN fmt_text || chr(10) || chr(10) ELSE '' END || 'Speech:' || chr(10) || '{{{{SPEECH}}}}' AS usr
  FROM {_values('role', _ROLES)}, {_values('task', _TASKS)}, {_values('fmt', _FORMATS)}, {_values('definition', _TOPICS)})
SELECT speech_id, 'role=' || role || '|task=' || task || '|format=' || fmt AS variant_id, definition,
  left(sha1(CASE WHEN role_text <> '' THEN '[system]' || chr(10) || role_text || chr(10) || chr(10) ELSE '' END || '[user]' || chr(10) || usr), 12) AS prompt_hash, md5(replace(usr, '{{{{SPEECH}}}}', speech_text)) AS digest
FROM calibration_speech, g"""


def _raw(s: SparkSession, d: str) -> DataFrame:
    raw = F.from_json("raw", "id string, model string, finish_reason string")
    rows = table(s, d, "call_result").select("call_id", "model_id", "finish_reason", raw.alias("r")).distinct()
    return rows.groupBy(F.col("r.model").alias("model"), F.col("r.finish_reason").alias("raw_reason")).agg(F.count("*").alias("n"), F.sum((F.col("r.model") == F.col("model_id")).cast("long")).alias("same_model"))


def _maps(s: SparkSession, d: str) -> DataFrame:
    one = cells(s, d).groupBy("output_format", "model_id").agg(F.round(F.avg("n_sub"), 4).alias("m"))
    built = one.groupBy("output_format").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model_id", "m")))).alias("by_model"))
    return built.select("output_format", F.size("by_model").alias("models"), F.array_join(F.map_keys("by_model"), ",").alias("names"), F.round(F.aggregate(F.map_values("by_model"), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    said = table(s, d, "call_result").filter("text is not null").select("speech_id", "call_id", text.reply_word(F.regexp_extract("text", r"^(\w+)", 1)).alias("r")).distinct()
    two = said.groupBy("speech_id").agg(F.min_by("r", "call_id").alias("a"), F.max_by("r", "call_id").alias("b"))
    return two.select("speech_id", stages.two_candidates(F.col("a"), F.col("b")).alias("verdict"))


_VERDICTS = """WITH s AS (SELECT DISTINCT speech_id, call_id, CASE WHEN lower(regexp_extract(text, '^(\\w+)', 1)) IN ('yes', 'no') THEN lower(regexp_extract(text, '^(\\w+)', 1)) ELSE 'uncertain' END AS r FROM call_result WHERE text IS NOT NULL),
t AS (SELECT speech_id, arg_min(r, call_id) AS a, arg_max(r, call_id) AS b FROM s GROUP BY 1)
SELECT speech_id, CASE WHEN a = 'yes' OR b = 'yes' THEN 'yes' WHEN a = 'uncertain' OR b = 'uncertain' THEN 'uncertain' ELSE 'no' END AS verdict FROM t"""


def _themes_clean(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "call_result").select("call_id", "text").distinct()
    free = rows.select(answers.parsed(F.col("text"), F.lit("free"), 50).alias("p")).select(F.explode("p.subthemes").alias("theme"))
    return free.groupBy("theme").agg(F.count("*").alias("n"))


def _theme_agreement(s: SparkSession, d: str) -> DataFrame:
    # A cell is a call; rows that deliver it again are one.
    x = table(s, d, "extraction").filter("mentions_topic").select("speech_id", "model_id", "rep", F.col("subthemes").alias("themes")).distinct()
    lower = x.withColumn("themes", F.transform("themes", lambda t: F.lower(F.trim(t))))
    words = lower.select(F.explode("themes").alias("theme")).distinct()
    return reports.theme_agreement(lower, words.withColumn("vector", hashed_embedding(64)("theme")))


def _speech_lookup(s: SparkSession, d: str) -> DataFrame:
    year = table(s, d, "enriched").groupBy("speech_id").agg(F.max("year").alias("year"), F.max("word_count").alias("word_count"))
    return table(s, d, "call_result").join(year, "speech_id", "left").groupBy("model_id").agg(F.count("*").alias("calls"), F.count("year").alias("with_year"), F.sum("word_count").alias("words"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "flt4_arm": (lambda s, d: stages.arm(cells(s, d), condition="temp0", output_format="json", task="v1", definition="current").groupBy("model_id").agg(F.count("*").alias("n"), F.sum("n_sub").alias("themes")), f"WITH {CELLS} SELECT model_id, count(*) AS n, CAST(sum(n_sub) AS BIGINT) AS themes FROM cell WHERE {_ARM} GROUP BY 1"),
    "flt9_unresolved": (lambda s, d: stages.unresolved(table(s, d, "speaker_parties_without_url"), "party").select("speaker_name", "start_year").distinct(), "SELECT DISTINCT speaker_name, start_year FROM speaker_parties_without_url WHERE trim(coalesce(party, '')) = ''"),
    "prj3_pool_label": (_pool_labels, "SELECT DISTINCT speech_id, CASE WHEN speech_id IN (SELECT speech_id FROM extraction) THEN 'pilot' WHEN speech_id IN (SELECT speech_id FROM meta) THEN 'filter_pool' ELSE 'unknown' END AS pool FROM enriched"),
    "prj12_verdicts": (_verdicts, _VERDICTS),
    "join3_null_keys": (_null_cells, "WITH m AS (SELECT DISTINCT speech_id, era, seed_present FROM meta) SELECT *, count(*) OVER (PARTITION BY era, seed_present) AS cell_pop FROM m"),
    "join4_lookup": (_speech_lookup, "WITH y AS (SELECT speech_id, max(year) AS year, max(word_count) AS word_count FROM enriched GROUP BY 1) SELECT model_id, count(*) AS calls, count(year) AS with_year, CAST(sum(word_count) AS BIGINT) AS words FROM call_result LEFT JOIN y USING (speech_id) GROUP BY 1"),
    "arr3_cell_pairs": (_cell_pairs, f"WITH {CELLS}, c AS (SELECT DISTINCT speech_id, role || '|' || task || '|' || output_format || '|' || model_id AS cell FROM cell WHERE condition = 'temp0' AND task <> 'v1_nocap' AND definition = 'current') SELECT a.speech_id, count(*) AS pairs FROM c a JOIN c b ON a.speech_id = b.speech_id AND a.cell < b.cell GROUP BY 1"),
    "arr5_maps": (_maps, f"WITH {CELLS}, o AS (SELECT output_format, model_id, round(avg(n_sub), 4) AS m FROM cell GROUP BY 1, 2) SELECT output_format, CAST(count(*) AS INT) AS models, string_agg(model_id, ',' ORDER BY model_id) AS names, round(sum(m), 3) AS total FROM o GROUP BY 1"),
    "set3_sizes": (_sets, """WITH e AS (SELECT DISTINCT speech_id FROM enriched WHERE speech_id IS NOT NULL), m AS (SELECT DISTINCT speech_id FROM meta WHERE speech_id IS NOT NULL), x AS (SELECT DISTINCT speech_id FROM extraction WHERE speech_id IS NOT NULL)
        SELECT 'enriched and meta' AS what, count(*) AS n FROM e WHERE speech_id IN (SELECT * FROM m) UNION ALL SELECT 'enriched less meta', count(*) FROM e WHERE speech_id NOT IN (SELECT * FROM m)
        UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM e UNION SELECT * FROM m UNION SELECT * FROM x) UNION ALL SELECT 'meta and extraction', count(*) FROM (SELECT * FROM m INTERSECT SELECT * FROM x) UNION ALL SELECT 'extraction less meta', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM m)"""),
    "agg8_spans": (_spans, "SELECT source, min(sitting_date)::VARCHAR AS first, max(sitting_date)::VARCHAR AS last, count(*) AS n, CAST(date_diff('day', min(sitting_date), max(sitting_date)) AS INT) AS gap_days FROM documents GROUP BY 1"),
    "agg9_first": (_first_verdicts, f"WITH {CELLS} SELECT speech_id, model_id, arg_min(mentions_topic, ord) FILTER (mentions_topic IS NOT NULL) AS first, max(ord) AS last FROM cell GROUP BY 1, 2"),
    "agg14_spellings": (_spellings, "SELECT lower(trim(party)) AS party, string_agg(DISTINCT party, '; ' ORDER BY party) AS spellings, count(DISTINCT speaker_name) AS speakers FROM speaker_parties_without_url WHERE trim(party) <> '' GROUP BY 1"),
    "agg18_coverage": (
        lambda s, d: reports.coverage(table(s, d, "enriched"), {"meta": table(s, d, "meta"), "extraction": table(s, d, "extraction")}, "speech_id"),
        "WITH e AS (SELECT DISTINCT speech_id FROM enriched WHERE speech_id IS NOT NULL) SELECT count(*) AS keys, round(avg((speech_id IN (SELECT speech_id FROM meta))::INT), 6) AS meta, round(avg((speech_id IN (SELECT speech_id FROM extraction))::INT), 6) AS extraction FROM e",
    ),
    "top1_top_k": (lambda s, d: reports.top(scores(s, d), ["query_id"], "score", "vec_id", 25), f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, vec_id) AS rank FROM score) SELECT vec_id, query_id, score, relevant, CAST(rank AS INT) AS rank FROM r WHERE rank <= 25"),
    "top5_threshold": (
        lambda s, d: reports.threshold_at(metrics.sweep(scores(s, d), ["query_id"], "score", "relevant"), ["query_id"], 0.1),
        f"""WITH {SCORES}, g AS (SELECT i / 20 AS threshold FROM range(4, 17) t(i)), w AS (SELECT query_id, threshold, round(sum((score >= threshold)::INT) / count(*), 6) AS retained, round(sum(CASE WHEN score >= threshold THEN relevant ELSE 0 END) / sum(relevant), 6) AS recall FROM score, g GROUP BY 1, 2)
        SELECT query_id, max(threshold) AS threshold, arg_max(retained, threshold) AS retained FROM w WHERE recall >= 0.1 GROUP BY 1""",
    ),
    "str17_profiles": (_profiles, _PROFILES),
    "str18_prompts": (_prompts, _PROMPTS),
    "str7_themes": (_themes_clean, None),
    "prj6_raw": (_raw, """WITH u AS (SELECT DISTINCT call_id, model_id, finish_reason, raw FROM call_result) SELECT json_extract_string(raw, '$.model') AS model, json_extract_string(raw, '$.finish_reason') AS raw_reason, count(*) AS n, CAST(sum((json_extract_string(raw, '$.model') = model_id)::INT) AS BIGINT) AS same_model FROM u GROUP BY 1, 2"""),
    "met12_theme_agreement": (_theme_agreement, None),
}
