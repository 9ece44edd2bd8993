"""Queries of the core: name -> (Spark query, SQL or None). Names begin with the operator they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions import answers, eras, names, text
from rostra.operators import clusters, intervals, metrics, retrieval, store, strata
from rostra.plans.views import ANALYSIS, CANDIDATES, CELLS, SCORES, candidates, cells, scores
from rostra.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
SEED_PILOT, SEED_EVAL, SEED_POOL = 20260629, 20260802, 20260731
_STRATA = ["era", "speech_type", "seed_present"]
_GRID = ("role", "task", "output_format", "model_id")


def _draw(seed: int, key: str = "speech_id") -> str:
    return f"md5({key} || '|{seed}'), {key}"


def _eras(s: SparkSession, d: str) -> DataFrame:
    era = eras.era_of(F.col("year"))
    rows = table(s, d, "enriched").select(era.alias("era"), eras.decade_of(F.col("year")).alias("decade_bin"))
    return rows.groupBy("era", "decade_bin").agg(F.count("*").alias("n"))


def _smp1(s: SparkSession, d: str) -> DataFrame:
    out = strata.stratified(candidates(s, d), _STRATA, "speech_id", F.when(F.col("seed_present"), 12).otherwise(6), SEED_PILOT)
    return out.select("speech_id", *_STRATA, "cell_pop", "cell_n", F.round("sampling_weight", 6).alias("sampling_weight"))


def _smp1_text(s: SparkSession, d: str) -> DataFrame:
    # The draw is at most 12 rows of 30 cells: its ids fetch the text in a second scan.
    ids = strata.stratified(candidates(s, d), _STRATA, "speech_id", F.when(F.col("seed_present"), 12).otherwise(6), SEED_PILOT).select("speech_id", "cell_pop")
    return table(s, d, "enriched").join(F.broadcast(ids), "speech_id").select("speech_id", "cell_pop", F.length("speech_text").alias("n_chars"), "chamber").distinct()


_SMP1 = f"""WITH {CANDIDATES}, r AS (
  SELECT *, count(*) OVER (PARTITION BY era, speech_type, seed_present) AS cell_pop,
    row_number() OVER (PARTITION BY era, speech_type, seed_present ORDER BY {_draw(SEED_PILOT)}) AS draw FROM cand
), k AS (SELECT * FROM r WHERE draw <= CASE WHEN seed_present THEN 12 ELSE 6 END
), w AS (SELECT *, count(*) OVER (PARTITION BY era, speech_type, seed_present) AS cell_n FROM k)
"""


def _smp4(s: SparkSession, d: str) -> DataFrame:
    out = strata.proportional(candidates(s, d), "decade_bin", "speech_id", 400, 10, SEED_EVAL)
    return out.select("speech_id", "decade_bin", "stratum_pop", F.round("sampling_weight", 6).alias("sampling_weight"))


_SMP4 = f"""WITH {CANDIDATES}, p AS (SELECT decade_bin, count(*) AS stratum_pop FROM cand GROUP BY 1),
q AS (SELECT *, least(stratum_pop, greatest(10, CAST(round_even(400.0::DOUBLE * stratum_pop / (SELECT sum(stratum_pop) FROM p), 0) AS BIGINT))) AS quota FROM p),
r AS (SELECT c.speech_id, c.decade_bin, stratum_pop, quota, row_number() OVER (PARTITION BY c.decade_bin ORDER BY {_draw(SEED_EVAL, 'c.speech_id')}) AS draw FROM cand c JOIN q USING (decade_bin))
SELECT speech_id, decade_bin, stratum_pop, round(stratum_pop / quota, 6) AS sampling_weight FROM r WHERE draw <= quota"""


def _smp5(s: SparkSession, d: str) -> DataFrame:
    pool = candidates(s, d)
    taken = pool.filter("seed_present and speech_type = 'long'")
    return strata.balanced(pool, "era", 5, "speech_id", 200, SEED_POOL, taken).select("speech_id", "era")


_SMP5 = f"""WITH {CANDIDATES}, f AS (
  SELECT speech_id, 0 AS turn, md5(speech_id || '|{SEED_POOL}') AS spot, row_number() OVER (PARTITION BY era ORDER BY {_draw(SEED_POOL)}) AS r FROM cand
), m AS (SELECT speech_id, 1 AS turn, md5(speech_id || '|{SEED_POOL + 1}') AS spot FROM cand ORDER BY spot, speech_id LIMIT 400
), u AS (SELECT speech_id, turn, spot FROM f WHERE r <= 40 UNION ALL SELECT * FROM m
), e AS (SELECT * FROM u WHERE speech_id NOT IN (SELECT speech_id FROM cand WHERE seed_present AND speech_type = 'long')
), o AS (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY turn, spot) AS n FROM e
), p AS (SELECT speech_id FROM o WHERE n = 1 ORDER BY turn, spot, speech_id LIMIT 200)
SELECT speech_id, era FROM cand WHERE speech_id IN (SELECT speech_id FROM p)"""


def _smp6(s: SparkSession, d: str) -> DataFrame:
    drawn = strata.stratified(candidates(s, d), ["decade_bin"], "speech_id", 20, SEED_EVAL).select("speech_id", "decade_bin")
    return strata.systematic(drawn, ["decade_bin", "speech_id"], 60)


_SMP6 = f"""WITH {CANDIDATES}, r AS (SELECT speech_id, decade_bin, row_number() OVER (PARTITION BY decade_bin ORDER BY {_draw(SEED_EVAL)}) AS draw FROM cand),
s AS (SELECT speech_id, decade_bin, row_number() OVER (ORDER BY decade_bin, speech_id) - 1 AS i, count(*) OVER () AS n FROM r WHERE draw <= 20)
SELECT speech_id, decade_bin FROM s WHERE i % greatest(1, n // 60) = 0 AND i // greatest(1, n // 60) < 60"""

_BANDS = f"""WITH {SCORES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS up, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id DESC) AS down FROM score
), b AS (SELECT *, CASE WHEN up <= 20 THEN 'top' WHEN down <= 20 THEN 'bottom' ELSE 'mid' END AS band FROM r
), m AS (SELECT *, row_number() OVER (PARTITION BY query_id, band ORDER BY md5(vec_id || '|7'), vec_id) AS pick FROM b
), k AS (SELECT query_id, vec_id, band, score, relevant FROM m WHERE band <> 'mid' OR pick <= 20)
"""


def _bands(s: SparkSession, d: str) -> DataFrame:
    return strata.bands(scores(s, d), ["query_id"], "score", "vec_id", 20, 7).select("query_id", "vec_id", "band", "score", "relevant")


_ALPHA = """u AS (SELECT {g} {u}, count({r}) AS m, coalesce(sum({r}::BIGINT), 0) AS y FROM {t} GROUP BY ALL),
v AS (SELECT *, m - y AS z, (y * (y - 1) + (m - y) * (m - y - 1)) AS same FROM u WHERE m >= 2),
a AS (SELECT {g} sum(m) AS n, sum(same / (m - 1)) AS s, sum(y) AS y, sum(z) AS z, avg(same / (m * (m - 1))) AS p, count(*) AS units, quantile_cont(m, 0.5)::DOUBLE AS raters FROM v {by}),
e AS (SELECT *, (n::DOUBLE * n - y::DOUBLE * y - z::DOUBLE * z) / (n - 1) AS ex FROM a)
SELECT {g} round(CASE WHEN ex = 0 THEN 1.0 ELSE 1 - (n - s) / ex END, 4) AS alpha, round(p, 4) AS mean_pairwise_agreement, units, raters FROM e"""

_CORE = "core AS (SELECT * FROM cell WHERE condition = 'temp0' AND task <> 'v1_nocap' AND definition = 'current')"


def _decomposition_sql() -> str:
    parts = []
    for f in _GRID:
        others = ", ".join(["speech_id", *(x for x in _GRID if x != f)])
        parts.append(
            f"SELECT '{f}' AS factor, round(avg(1 - (y * (y - 1) + (m - y) * (m - y - 1)) / (m * (m - 1))), 6) AS disagreement, (SELECT count(DISTINCT {f}) FROM core) AS n_levels "
            f"FROM (SELECT count(mentions_topic) AS m, coalesce(sum(mentions_topic::BIGINT), 0) AS y FROM core GROUP BY {others}) WHERE m >= 2"
        )
    return f"WITH {CELLS}, {_CORE} " + " UNION ALL ".join(parts)


_VOTES = "vote AS (SELECT * FROM cell WHERE condition = 'temp0' AND output_format = 'json' AND parse_ok AND NOT coalesce(presence_inferred, false))"


def _loo_sql(by: str) -> str:
    return f"""WITH {CELLS}, {_VOTES}, h AS (SELECT speech_id, {by}, count(*) AS n, sum(mentions_topic::BIGINT) AS y FROM vote WHERE mentions_topic IS NOT NULL GROUP BY ALL),
t AS (SELECT speech_id, sum(n) AS n, sum(y) AS y FROM h GROUP BY 1), b AS (SELECT DISTINCT {by} FROM vote WHERE {by} IS NOT NULL),
r AS (SELECT b.{by}, t.speech_id, t.n - coalesce(h.n, 0) AS n, t.y - coalesce(h.y, 0) AS y FROM t CROSS JOIN b LEFT JOIN h ON h.speech_id = t.speech_id AND h.{by} = b.{by})
SELECT {by}, speech_id, round(y / n, 6) AS rate, CAST(n AS BIGINT) AS n, CAST(y / n >= 0.5 AS INT) AS label FROM r WHERE n >= 3"""


def _agg7(s: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    return scores(s, d).groupBy("query_id", "relevant").agg(r(F.avg("score"), "mean"), r(F.percentile("score", F.lit(0.5)), "p50"), r(F.percentile("score", F.lit(0.9)), "p90"), F.count("*").alias("n"))


def _models_as_rankings(s: SparkSession, d: str) -> DataFrame:
    # Every query is a ranking of the same vectors, as every embedder is of the same speeches.
    return scores(s, d).select("vec_id", F.col("query_id").alias("model"), "score")


_RANKINGS = f"""WITH {SCORES}, f AS (SELECT vec_id, query_id AS model, score FROM score),
r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS rk, CAST(row_number() OVER (PARTITION BY model ORDER BY score DESC, vec_id) <= 100 AS INT) AS top FROM f)
SELECT a.model AS a, b.model AS b, round(corr(a.rk, b.rk), 6) AS spearman, round(sum(a.top * b.top) / 100, 6) AS overlap, count(*) AS n
FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.model < b.model GROUP BY 1, 2"""


def _chunk_scores(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # Vectors as chunks of 64 documents, of which those above 60 have none.
    v = table(s, d, "embeddings")
    q = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vec")).withColumnRenamed("label", "query_id")
    chunks = v.select((F.col("vec_id") % 60).alias("doc"), F.col("embedding").alias("vector"))
    docs = s.range(64).select(F.col("id").alias("doc"))
    return docs, q, retrieval.dense_scores(chunks, q, "doc", "vector").withColumn("score", F.round("score", 9))


def _vec5(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.pooled_chunks(*_chunk_scores(s, d), "doc")
    return out.select("doc", "query_id", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


_CHUNKS = f"WITH {SCORES}, c AS (SELECT vec_id % 60 AS doc, query_id, score FROM score), p AS (SELECT doc, query_id, max(score) AS best, avg(score) AS mean FROM c GROUP BY 1, 2)"


def _met8(s: SparkSession, d: str) -> DataFrame:
    return metrics.at_k(scores(s, d), ["query_id"], "score", "relevant", "vec_id", [10, 25, 50, 100])


def _gold_flags(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "extraction").filter("mentions_topic is not null").groupBy("speech_id").agg((F.avg(F.col("mentions_topic").cast("double")) >= 0.5).cast("int").alias("label"))
    flag = table(s, d, "meta").groupBy("speech_id").agg(F.max("seed_present").alias("flag"))
    return one.join(flag, "speech_id").filter("flag is not null")


def _parsed(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "call_result").select("call_id", "text").distinct()
    form = F.when(F.coalesce(F.trim("text"), F.lit("")).rlike(r"^[`{]"), "json").otherwise("free")
    return rows.select("call_id", answers.parsed(F.col("text"), form).alias("p")).select("call_id", "p.*")


def _reparsed(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "call_result").select("call_id", F.col("text").alias("raw_text"), "error", F.when(F.col("prompt_text").contains("JSON"), "json").otherwise("free").alias("output_format"), F.lit("v1").alias("task")).distinct()
    out = store.reparsed(rows)
    return out.groupBy("output_format", "parse_ok", "parse_error", "presence_inferred", "mentions_topic").agg(F.count("*").alias("n"))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    speeches = table(s, d, "meta").select("speech_id").distinct()
    variants = s.createDataFrame([("h0",), ("h1",)], "prompt_hash string")
    models = table(s, d, "model_registry").select("model_id")
    conditions = s.createDataFrame([(0.0, 42, 1), (0.7, None, 2)], "temperature double, seed long, reps int")
    calls = table(s, d, "call_result").filter("error is null").select("speech_id", F.lit("h0").alias("prompt_hash"), "model_id", "temperature", "seed", F.lit(0).alias("rep")).distinct()
    left = store.jobs(speeches, variants, models, conditions, calls)
    return left.groupBy("model_id", "prompt_hash", "temperature", "rep").agg(F.count("*").alias("jobs"))


_JOBS = """WITH s AS (SELECT DISTINCT speech_id FROM meta), v AS (SELECT * FROM (VALUES ('h0'), ('h1')) t(prompt_hash)),
c AS (SELECT * FROM (VALUES (0.0::DOUBLE, 42::BIGINT, 0), (0.7::DOUBLE, NULL, 0), (0.7::DOUBLE, NULL, 1)) t(temperature, seed, rep)),
d AS (SELECT DISTINCT speech_id, model_id, temperature, seed FROM call_result WHERE error IS NULL)
SELECT m.model_id, prompt_hash, c.temperature, rep, count(*) AS jobs FROM s CROSS JOIN v CROSS JOIN (SELECT model_id FROM model_registry) m CROSS JOIN c
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.speech_id = s.speech_id AND prompt_hash = 'h0' AND d.model_id = m.model_id AND d.temperature = c.temperature AND d.seed IS NOT DISTINCT FROM c.seed AND rep = 0)
GROUP BY ALL"""

_CALL_KEY = ["speech_id", "model_id", "temperature", "seed"]


def _latest(s: SparkSession, d: str) -> DataFrame:
    out = store.latest(table(s, d, "call_result"), _CALL_KEY, ["ts", "call_id"])
    return out.select(*_CALL_KEY, "call_id", F.length("text").alias("n_chars"))


def _determinism(s: SparkSession, d: str) -> DataFrame:
    calls = table(s, d, "call_result").select("call_id", "speech_id", "model_id", "temperature", "seed", "text", "finish_reason").distinct()
    return metrics.determinism(calls, _CALL_KEY, "text", "finish_reason", "model_id")


def _overlay(s: SparkSession, d: str) -> DataFrame:
    # A later delivery of a speech fills what the first left null.
    fields = ["year", "chamber", "word_count", "section_title"]
    rows = table(s, d, "enriched").select("speech_id", "loaded_at", *fields)
    return rows.groupBy("speech_id").agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.struct("loaded_at", f))).alias(f) for f in fields))


_OVERLAY = "SELECT speech_id, " + ", ".join(
    f"arg_min({f}, (loaded_at, {f})) FILTER ({f} IS NOT NULL) AS {f}" for f in ("year", "chamber", "word_count", "section_title")
) + " FROM enriched GROUP BY speech_id"


def _names(s: SparkSession, d: str) -> DataFrame:
    n = names.clean_name(F.col("speaker_name"))
    return table(s, d, "speaker_parties_without_url").select(n.alias("name")).groupBy("name").agg(F.count("*").alias("n"))


_NAMES = f"""WITH a AS (SELECT regexp_replace(trim(coalesce(speaker_name, '')), '\\s+({names.VERBS})$', '', 'i') AS n FROM speaker_parties_without_url),
b AS (SELECT regexp_replace(n, '^({names.HONORIFICS})\\.?,?\\s+', '', 'i') AS n FROM a), c AS (SELECT lower(regexp_replace(n, '^(the|a|an)\\s+', '', 'i')) AS n FROM b),
d AS (SELECT regexp_replace(n, '^[^a-z\\s-]+|[^a-z\\s-]+$', '', 'g') AS n FROM c)
SELECT trim(regexp_replace(n, '\\s+', ' ', 'g')) AS name, count(*) AS n FROM d GROUP BY 1"""


def _text_scalars(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "call_result").filter("text is not null").select(
        "call_id", text.content_hash(t).alias("hash"), text.quoted_span(t).alias("quote"), F.length(text.outer_object(t)).alias("object_chars"),
        text.reply_word(F.regexp_extract(t, r"^(\w+)", 1)).alias("reply"), text.truthy(F.regexp_extract(t, r"^(\w+)", 1)).alias("verdict"), text.token_budget(t, 40).alias("short"),
    ).distinct()


_TEXT_SCALARS = """WITH t AS (SELECT call_id, text, lower(regexp_extract(text, '^(\\w+)', 1)) AS w, instr(text, '{') AS a, length(text) - instr(reverse(text), '}') + 1 AS b FROM call_result WHERE text IS NOT NULL),
o AS (SELECT *, substr(text, CAST(a AS BIGINT), CAST(b - a + 1 AS BIGINT)) AS i FROM t)
SELECT DISTINCT call_id, left(sha1(text), 12) AS hash, coalesce(nullif(regexp_extract(text, '"([^"]{8,400})"', 1), ''), nullif(regexp_extract(text, '''([^'']{8,400})''', 1), ''), '') AS quote,
  length(CASE WHEN a > 0 AND instr(text, '}') > 0 AND b >= a AND length(replace(i, '{', '')) = length(replace(i, '}', '')) THEN i ELSE 'null' END) AS object_chars,
  CASE WHEN w IN ('yes', 'no') THEN w ELSE 'uncertain' END AS reply, CASE WHEN w IN ('true', 'yes', 'y', '1') THEN true WHEN w IN ('false', 'no', 'n', '0') THEN false END AS verdict, length(text) // 4 <= 40 AS short
FROM o"""


def _windows(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").filter("length(text) > 0").select("doc_id", F.posexplode(text.hard_windows(F.col("text"))).alias("i", "w"))
    return rows.select("doc_id", "i", F.md5("w").alias("digest"))


def _years(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(text.years_in(F.col("text"))).alias("years"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select(F.col("label").cast("string").alias("arm"), F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("phrase"), F.col("embedding").alias("vector"), F.array("vec_id").alias("speech_ids"))
    return clusters.theme_clusters(v, 0.9)


def _speakers(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "speaker_parties_without_url").select(F.col("speaker_name").alias("speaker"), F.concat(F.col("start_year").cast("string"), F.lit("-01-01")).alias("date"))
    return clusters.speakers(rows)


def _themes(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "extraction").select("speech_id", F.explode("subthemes").alias("t")).select("speech_id", F.lower(F.trim("t")).alias("theme"))
    return x.groupBy("theme").agg(F.count("*").alias("emissions"), F.countDistinct("speech_id").alias("speeches"))


def _vote_rows(s: SparkSession, d: str) -> DataFrame:
    return metrics.votes(cells(s, d))


def _pivot(s: SparkSession, d: str) -> DataFrame:
    year = F.lit(1803) + F.col("speech_id") * 7919 % 223
    c = cells(s, d).withColumn("era", eras.era_of(year))
    out = c.groupBy("era").pivot("definition", ["current", "era_neutral", "expert", "name_only"]).agg(F.round(F.avg(F.col("mentions_topic").cast("double")), 6))
    return out


_PIVOT = f"""WITH {CELLS}, e AS (SELECT *, 1803 + speech_id * 7919 % 223 AS year FROM cell), f AS (SELECT *, {ANALYSIS} AS era FROM e)
SELECT era, """ + ", ".join(f"round(avg(mentions_topic::INT) FILTER (definition = '{x}'), 6) AS {x}" for x in ("current", "era_neutral", "expert", "name_only")) + " FROM f GROUP BY 1"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "p2_found": (lambda s, d: intervals.party_periods(table(s, d, "speaker_parties_without_url")), intervals.PARTY_PERIODS_SQL),
    "flt1_candidates": (candidates, f"WITH {CANDIDATES} SELECT * FROM cand"),
    "dt1_eras": (_eras, f"SELECT {ANALYSIS} AS era, CAST(floor(year / 10) * 10 AS INT) AS decade_bin, count(*) AS n FROM enriched GROUP BY 1, 2"),
    "smp1_stratified": (_smp1, _SMP1 + "SELECT speech_id, era, speech_type, seed_present, cell_pop, cell_n, round(cell_pop / cell_n, 6) AS sampling_weight FROM w"),
    "smp2_late_text": (_smp1_text, _SMP1 + "SELECT DISTINCT speech_id, cell_pop, length(speech_text) AS n_chars, chamber FROM enriched JOIN w USING (speech_id)"),
    "smp3_cell_counts": (lambda s, d: candidates(s, d).groupBy(*_STRATA).agg(F.count("*").alias("n")), f"WITH {CANDIDATES} SELECT era, speech_type, seed_present, count(*) AS n FROM cand GROUP BY ALL"),
    "smp4_proportional": (_smp4, _SMP4),
    "smp5_balanced": (_smp5, _SMP5),
    "smp6_systematic": (_smp6, _SMP6),
    "smp7_bands": (_bands, _BANDS + "SELECT * FROM k"),
    "agg7_quantiles": (_agg7, f"WITH {SCORES} SELECT query_id, relevant, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, count(*) AS n FROM score GROUP BY 1, 2"),
    "agg10_pivot": (_pivot, _PIVOT),
    "agg17_themes": (_themes, "SELECT lower(trim(t)) AS theme, count(*) AS emissions, count(DISTINCT speech_id) AS speeches FROM (SELECT speech_id, unnest(subthemes) AS t FROM extraction) GROUP BY 1"),
    "met1_alpha": (lambda s, d: metrics.krippendorff(table(s, d, "extraction"), ["speech_id"], "mentions_topic"), "WITH " + _ALPHA.format(g="", u="speech_id", r="mentions_topic", t="extraction", by="")),
    "met3_presence": (lambda s, d: metrics.krippendorff(metrics.core_grid(cells(s, d)), ["speech_id"], "mentions_topic", ["model_id"]), f"WITH {CELLS}, {_CORE}, " + _ALPHA.format(g="model_id,", u="speech_id", r="mentions_topic", t="core", by="GROUP BY model_id")),
    "met4_factors": (lambda s, d: metrics.factor_decomposition(metrics.core_grid(cells(s, d)), "speech_id", "mentions_topic", _GRID), _decomposition_sql()),
    "met5_self_consistency": (
        lambda s, d: metrics.krippendorff(cells(s, d).filter("condition = 'temp07'"), ["speech_id", "role", "task", "definition", "model_id"], "mentions_topic"),
        f"WITH {CELLS}, x AS (SELECT * FROM cell WHERE condition = 'temp07'), " + _ALPHA.format(g="", u="speech_id, role, task, definition, model_id", r="mentions_topic", t="x", by=""),
    ),
    "met6_ranking": (
        lambda s, d: metrics.ranking(scores(s, d), ["query_id"], "score", "relevant"),
        f"""WITH {SCORES}, g AS (SELECT query_id, score, count(*) AS n, sum(relevant) AS tp FROM score GROUP BY 1, 2),
        r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk, sum(tp) OVER d AS ctp, sum(n) OVER d AS cn,
          sum(tp) OVER (PARTITION BY query_id) AS p, sum(n) OVER (PARTITION BY query_id) - sum(tp) OVER (PARTITION BY query_id) AS q FROM g WINDOW d AS (PARTITION BY query_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
        SELECT query_id, round((sum(rk * tp) - p * (p + 1) / 2) / (p * q), 6) AS auroc, round(sum(tp / p * ctp / cn), 6) AS ap, CAST(p AS BIGINT) AS positives, CAST(q AS BIGINT) AS negatives FROM r WHERE p > 0 AND q > 0 GROUP BY query_id, p, q""",
    ),
    "met8_at_k": (
        _met8,
        f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn, sum(relevant) OVER (PARTITION BY query_id) AS p FROM score)
        SELECT query_id, k, round(sum(relevant) / count(*), 6) AS precision, round(sum(relevant) / max(p), 6) AS recall FROM r, (VALUES (10), (25), (50), (100)) t(k) WHERE rn <= k GROUP BY 1, 2""",
    ),
    "met8_sweep": (
        lambda s, d: metrics.sweep(scores(s, d), ["query_id"], "score", "relevant"),
        f"""WITH {SCORES}, g AS (SELECT i / 20 AS threshold FROM range(4, 17) t(i))
        SELECT query_id, threshold, round(sum(CAST(score >= threshold AS INT)) / count(*), 6) AS retained,
          round(CASE WHEN sum(CAST(score >= threshold AS INT)) > 0 THEN sum(CASE WHEN score >= threshold THEN relevant ELSE 0 END) / sum(CAST(score >= threshold AS INT)) END, 6) AS precision,
          round(CASE WHEN sum(relevant) > 0 THEN sum(CASE WHEN score >= threshold THEN relevant ELSE 0 END) / sum(relevant) END, 6) AS recall FROM score, g GROUP BY 1, 2""",
    ),
    "met8_baseline": (
        lambda s, d: metrics.baseline(_gold_flags(s, d), "flag", "label"),
        """WITH o AS (SELECT speech_id, CAST(avg(mentions_topic::INT) >= 0.5 AS INT) AS label FROM extraction WHERE mentions_topic IS NOT NULL GROUP BY 1), f AS (SELECT speech_id, max(seed_present::INT) AS flag FROM meta GROUP BY 1),
        j AS (SELECT label, flag FROM o JOIN f USING (speech_id) WHERE flag IS NOT NULL) SELECT round(sum(flag * label) / sum(flag), 6) AS precision, round(sum(flag * label) / sum(label), 6) AS recall FROM j""",
    ),
    "smp8_verification": (lambda s, d: strata.verification(table(s, d, "enriched"), "speech_id", 50, SEED_EVAL), f"SELECT speech_id FROM (SELECT DISTINCT speech_id FROM enriched WHERE speech_id IS NOT NULL) ORDER BY {_draw(SEED_EVAL)} LIMIT 50"),
    "met9_rank_agreement": (lambda s, d: metrics.rank_agreement(_models_as_rankings(s, d), "vec_id", "model", "score", 100), _RANKINGS),
    "met10_length_bias": (
        lambda s, d: metrics.length_bias(scores(s, d).join(table(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 97).alias("words")), "vec_id"), ["query_id"], "score", "words"),
        f"WITH {SCORES} SELECT query_id, round(corr(score, ln(greatest(vec_id % 97, 1))), 6) AS length_corr, count(*) AS n FROM score GROUP BY 1",
    ),
    "met11_prevalence": (
        lambda s, d: metrics.prevalence(metrics.core_grid(cells(s, d)), ["role", "task", "output_format", "model_id"], "mentions_topic"),
        f"""WITH {CELLS}, {_CORE}, c AS (SELECT avg(mentions_topic::INT) AS p FROM core GROUP BY role, task, output_format, model_id)
        SELECT round(avg(p), 6) AS mean, round(min(p), 6) AS min, round(max(p), 6) AS max, round(stddev_samp(p), 6) AS sd, round(max(p) - min(p), 6) AS spread, count(*) AS cells FROM c WHERE p IS NOT NULL""",
    ),
    "met13_gold": (
        lambda s, d: metrics.gold(_vote_rows(s, d), 3),
        f"""WITH {CELLS}, {_VOTES}, g AS (SELECT speech_id, avg(mentions_topic::INT) AS r, count(mentions_topic) AS n FROM vote GROUP BY 1)
        SELECT speech_id, round(r, 6) AS rate, n, CAST(r >= 0.5 AS INT) AS label FROM g WHERE n >= 3""",
    ),
    "met13_leave_definition_out": (lambda s, d: metrics.leave_one_out(_vote_rows(s, d), "definition", 3), _loo_sql("definition")),
    "met13_leave_model_out": (lambda s, d: metrics.leave_one_out(_vote_rows(s, d), "model_id", 3), _loo_sql("model_id")),
    "met14_model_agreement": (
        lambda s, d: metrics.model_agreement(cells(s, d), 30),
        f"""WITH {CELLS}, o AS (SELECT speech_id, model_id, arg_min(mentions_topic, ord) AS v FROM cell WHERE mentions_topic IS NOT NULL GROUP BY 1, 2)
        SELECT a.model_id AS model_a, b.model_id AS model_b, count(*) AS n, round(avg((a.v = b.v)::INT), 6) AS agreement FROM o a JOIN o b ON a.speech_id = b.speech_id AND a.model_id < b.model_id GROUP BY 1, 2 HAVING count(*) >= 30""",
    ),
    "met15_determinism": (
        _determinism,
        """WITH u AS (SELECT DISTINCT call_id, speech_id, model_id, temperature, seed, text, finish_reason FROM call_result),
        c AS (SELECT model_id, count(*) AS n, (count(DISTINCT text) + max((text IS NULL)::INT) = 1)::INT AS b, (count(DISTINCT finish_reason) + max((finish_reason IS NULL)::INT) = 1)::INT AS l FROM u GROUP BY speech_id, model_id, temperature, seed)
        SELECT model_id, count(*) AS cells, round(avg(b), 6) AS byte_identical, round(avg(l), 6) AS label_stable FROM c WHERE n >= 2 GROUP BY 1""",
    ),
    "met16_format_effect": (
        lambda s, d: metrics.format_effect(cells(s, d)),
        f"""WITH {CELLS} SELECT output_format, count(*) AS n, round(avg(mentions_topic::INT) FILTER (parse_ok), 6) AS raw_rate, round(avg(mentions_topic::INT) FILTER (parse_ok AND NOT presence_inferred), 6) AS stated_rate,
        round(avg(presence_inferred::INT) FILTER (parse_ok), 6) AS inferred_share, round(avg((NOT parse_ok)::INT), 6) AS fail_share FROM cell GROUP BY 1""",
    ),
    "met17_cap_effect": (
        lambda s, d: metrics.cap_effect(cells(s, d), ["model_id", "output_format"], "task", "v1", "v1_nocap", "n_sub"),
        f"""WITH {CELLS}, x AS (SELECT speech_id, model_id, output_format, avg(n_sub) FILTER (task = 'v1') AS c, avg(n_sub) FILTER (task = 'v1_nocap') AS u FROM cell WHERE task IN ('v1', 'v1_nocap') GROUP BY ALL)
        SELECT speech_id, round(avg(c - u), 6) AS cap_effect, count(*) AS cells FROM x WHERE c IS NOT NULL AND u IS NOT NULL GROUP BY 1""",
    ),
    "met18_definition_split": (
        lambda s, d: metrics.definition_split(cells(s, d), "definition"),
        f"""WITH {CELLS}, r AS (SELECT speech_id, definition, avg(mentions_topic::INT) AS r FROM cell WHERE mentions_topic IS NOT NULL GROUP BY 1, 2)
        SELECT speech_id, round(max(2 * least(r, 1 - r)), 6) AS split, round(max(r) - min(r), 6) AS gap, count(*) AS definitions FROM r GROUP BY 1""",
    ),
    "met19_band_summary": (
        lambda s, d: _bands(s, d).groupBy("query_id", "band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("relevant"), 6).alias("rate")),
        _BANDS + "SELECT query_id, band, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(relevant), 6) AS rate FROM k GROUP BY 1, 2",
    ),
    "vec3_scores": (scores, f"WITH {SCORES} SELECT vec_id, query_id, score, relevant FROM score"),
    "vec4_best_chunk": (
        lambda s, d: retrieval.best_chunk(_chunk_scores(s, d)[2], "doc").withColumn("score", F.round("score", 6)),
        _CHUNKS + " SELECT doc, query_id, round(best, 6) AS score FROM p",
    ),
    "vec5_pooled_chunks": (_vec5, _CHUNKS + " SELECT d.doc, q.query_id, round(coalesce(best, 0), 6) AS best, round(coalesce(mean, 0), 6) AS mean FROM range(64) d(doc) CROSS JOIN qry q LEFT JOIN p ON p.doc = d.doc AND p.query_id = q.query_id"),
    "str1_sentences": (lambda s, d: table(s, d, "enriched").filter("speech_text is not null").select("speech_id", F.posexplode(text.plain_sentences(F.col("speech_text"))).alias("i", "sentence")).distinct(), None),
    "str2_windows": (
        _windows,
        """SELECT doc_id, CAST(i AS INT) AS i, md5(substr(text, i * 320 + 1, 400)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 400) / 320) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0)""",
    ),
    "str3_chunks": (lambda s, d: retrieval.chunk_rows(table(s, d, "enriched").select("speech_id", "speech_text").distinct(), "speech_id", "speech_text"), None),
    "str4_names": (_names, _NAMES),
    "str5_blocks": (lambda s, d: table(s, d, "speaker_parties_without_url").select(names.block_key(names.clean_name(F.col("speaker_name"))).alias("block")).groupBy("block").agg(F.count("*").alias("n")), None),
    "str8_scalars": (_text_scalars, _TEXT_SCALARS),
    "str13_gender": (
        lambda s, d: table(s, d, "speaker_parties_without_url").select(names.title_gender(F.col("speaker_name")).alias("gender")).groupBy("gender").agg(F.count("*").alias("n")),
        f"""WITH g AS (SELECT lower(regexp_extract(speaker_name, '\\b({'|'.join(sorted(names.MALE + names.FEMALE, key=len, reverse=True))})\\b', 1, 'i')) AS w FROM speaker_parties_without_url)
        SELECT CASE WHEN w IN {names.MALE!r} THEN 'male' WHEN w IN {names.FEMALE!r} THEN 'female' END AS gender, count(*) AS n FROM g GROUP BY 1""",
    ),
    "str15_years": (_years, "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\\b(1\\d{3}|20\\d{2})\\b', 1)))::INT AS years FROM documents"),
    "jsn4_parsed": (_parsed, None),
    "sto3_jobs": (_jobs, _JOBS),
    "sto4_budget": (
        lambda s, d: table(s, d, "model_registry").crossJoin(s.createDataFrame([("v1",), ("v1_nocap",)], "task string")).select("model_id", "task", store.token_budget(F.col("task"), F.col("max_tokens")).alias("budget"), store.theme_cap(F.col("task")).alias("cap")),
        "SELECT model_id, task, CASE WHEN task = 'v1_nocap' THEN greatest(1024, max_tokens) ELSE max_tokens END AS budget, CASE WHEN task = 'v1_nocap' THEN 50 ELSE 5 END AS cap FROM model_registry, (VALUES ('v1'), ('v1_nocap')) t(task)",
    ),
    "sto7_reparsed": (_reparsed, None),
    "sto8_latest": (
        _latest,
        """SELECT speech_id, model_id, temperature, seed, call_id, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY speech_id, model_id, temperature, seed ORDER BY ts DESC, call_id DESC) AS n FROM call_result) WHERE n = 1""",
    ),
    "agg9_first_filled": (_overlay, _OVERLAY),
    "clu1_themes": (_clusters, None),
    "clu2_speakers": (_speakers, None),
}
