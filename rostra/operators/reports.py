"""Reports over results: theme agreement, thresholds, coverage, and text for readers."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.functions.text import truncated
from rostra.operators import metrics
from rostra.operators.clusters import numbered
from rostra.operators.strata import first_of_each
from rostra.runtime import map_rows, small_rows

#: Theme lists of a speech that are compared with each other at a time, and numbers in one table of cosines.
BLOCK, CELLS = 256, 1 << 22


def _matched(x: list, y: list, tau: float) -> np.ndarray:
    """Soft Jaccard of every list of vectors of ``x`` with every one of ``y``, matched greedily in the order of the first."""
    sizes, widths = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    most, dim = widths.max(), len(y[0][0])
    right = np.zeros((len(y), most, dim))
    for i, v in enumerate(y):
        right[i, : len(v)] = v
    flat, out = right.reshape(-1, dim).T, np.empty((len(x), len(y)))
    step = max(1, CELLS // flat.shape[1])
    for low in range(0, len(x), step):
        n = sizes[low : low + step]
        free = np.repeat((np.arange(most) < widths[:, None])[None], len(n), axis=0)
        met = np.zeros((len(n), len(y)))
        for i in range(n.max()):
            rows = np.flatnonzero(n > i)
            sims = np.round(np.array([x[low + r][i] for r in rows]) @ flat, 9).reshape(len(rows), len(y), most)
            sims = np.where(free[rows], sims, -np.inf)
            best = sims.argmax(axis=2)
            r, c = np.nonzero(sims.max(axis=2) >= tau)
            free[rows[r], c, best[r, c]] = False
            met[rows[r], c] += 1
        out[low : low + step] = met / (n[:, None] + widths - met)
    return out


def theme_agreement(cells: DataFrame, vectors: DataFrame, tau: float = 0.72) -> DataFrame:
    """Mean soft Jaccard over all pairs of non-empty cells of a speech: (speech_id, agreement, pairs).

    ``cells`` has speech_id and themes, a row for each cell; ``vectors`` has theme and vector. Equal lists of a speech are
    counted: two lists stand for the product of their counts, and n cells of one list for n (n - 1) / 2 pairs of it with
    itself. The list with the lesser hash is matched in its order. Lists of a speech are paired by blocks of about
    ``BLOCK``, so the pairs of a large speech are spread over tasks and never written out.
    """
    lists = cells.filter("speech_id is not null and size(themes) > 0").groupBy("speech_id", "themes").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("themes"))
    sizes = lists.groupBy("speech_id").agg(F.sum("n").alias("cells"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("cells > 1")
    named = lists.join(sizes, "speech_id").select("speech_id", "h", "themes", "n", "blocks", F.posexplode("themes").alias("i", "theme")).join(vectors, "theme")
    sets = named.groupBy("speech_id", "h", "themes", "n", "blocks").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "vector"))), lambda x: x["vector"]).alias("v"))
    # Blocks are ranges of the hash, so that their order is the order of its values.
    block = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("blocks")).cast("int"), F.col("blocks") - 1)
    blocks = sets.withColumn("block", block).groupBy("speech_id", "blocks", "block").agg(F.collect_list(F.struct("h", "themes", "n", "v")).alias("lists"))
    spread = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread.groupBy("speech_id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(F.struct("block", "lists")).alias("sides"))

    def score(rows: Iterator[tuple]) -> Iterator[tuple]:
        for speech, low, high, sides in rows:
            by = {s["block"]: sorted(s["lists"], key=lambda x: (x["h"], [t or "" for t in x["themes"]])) for s in sides}
            if low not in by or high not in by:
                continue
            x, y = by[low], by[high]
            n, m = (np.array([s["n"] for s in side], dtype=float) for side in (x, y))
            weight = np.outer(n, m)
            if low == high:
                weight = np.triu(weight, 1) + np.diag(n * (n - 1) / 2)
            total = int(weight.sum())
            if total:
                yield (speech, float((weight * _matched([s["v"] for s in x], [s["v"] for s in y], tau)).sum()), total)

    kind = cells.schema["speech_id"].dataType.simpleString()
    parts = map_rows(pairs, score, f"speech_id {kind}, j double, n long")
    return parts.groupBy("speech_id").agg(F.round(F.sum("j") / F.sum("n"), 6).alias("agreement"), F.sum("n").alias("pairs"))


def threshold_at(sweep: DataFrame, group: Sequence[str], recall: float) -> DataFrame:
    """The greatest threshold of each group that keeps the recall, with what it retains."""
    return sweep.filter(F.col("recall") >= recall).groupBy(*group).agg(F.max("threshold").alias("threshold"), F.max_by("retained", "threshold").alias("retained"))


def top(df: DataFrame, group: Sequence[str], score: str, key: str, k: int) -> DataFrame:
    """The first k rows of each group by score, nulls last, ties by key."""
    return first_of_each(df, group, [F.col(score).desc_nulls_last(), F.col(key)], key, k, "rank")


def coverage(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Distinct keys of a base and the share of them that each part has."""
    out = base.select(key).filter(F.col(key).isNotNull()).distinct()
    for name, part in parts.items():
        out = out.join(part.select(key, F.lit(1).alias(name)).distinct(), key, "left")
    return out.agg(F.count("*").alias("keys"), *(F.round(F.avg(F.coalesce(F.col(n), F.lit(0))), 6).alias(n) for n in parts))


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown section, in the order of its rows; one above ``most`` rows is an error, not cut."""
    rows = small_rows(df, most, f"report {title!r}")
    show = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"


def payload(df: DataFrame, most: int = 10_000) -> str:
    """A small result as JSON for a page, in the order of its rows; one above ``most`` rows is an error, not cut."""
    return json.dumps([r.asDict(recursive=True) for r in small_rows(df, most, "payload")], default=str)


def explorer(speeches: DataFrame, cells: DataFrame, text: str = "speech_text", most: int = 10_000, chars: int = 400) -> DataFrame:
    """Speeches with their cells as one nested row each, the payload of a page: (speech_id, year, section_title, excerpt, cells)."""
    fields = [c for c in cells.columns if c != "speech_id"]
    held = cells.groupBy("speech_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("cells"))
    return speeches.select("speech_id", "year", "section_title", truncated(F.col(text), chars).alias("excerpt")).join(held, "speech_id")


def gradient(rates: DataFrame, group: Sequence[str], era: str, rate: str, first: str, last: str) -> DataFrame:
    """How far the rate of a group rises from the first era to the last; null where it lacks one."""
    at = lambda name: F.max(F.when(F.col(era) == name, F.col(rate)))
    return rates.groupBy(*group).agg(F.round(at(last) - at(first), 6).alias("gradient"))


def contested(rates: DataFrame, key: str, by: str, rate: str, one: str, other: str) -> DataFrame:
    """Keys whose rates under two variants differ, the widest gap first: (key, gap, one, other)."""
    at = lambda name: F.max(F.when(F.col(by) == name, F.col(rate)))
    both = rates.groupBy(key).agg(at(one).alias("one"), at(other).alias("other")).filter("one is not null and other is not null")
    return both.select(key, F.round(F.abs(F.col("other") - F.col("one")), 6).alias("gap"), "one", "other").filter("gap > 0").orderBy(F.desc("gap"), key)


def effect_order(df: DataFrame, effect: str, key: str) -> DataFrame:
    """Rows with their rank by effect, the greatest first and those without one last."""
    return numbered(df, [F.col(effect).desc_nulls_last(), F.col(key)], "rank")


def ranked_results(df: DataFrame) -> DataFrame:
    """Results of configurations with their rank in a report: by average precision, then query and mode."""
    return numbered(df, [F.desc("ap"), F.col("query_id"), F.col("mode")], "rank")


def wide(df: DataFrame, key: str, by: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column for each named value of ``by``: what it gives for a key."""
    return df.groupBy(key).pivot(by, list(names)).agg(F.first(value, True))


def headline(cells: DataFrame, sampled: DataFrame, core: DataFrame) -> DataFrame:
    """The headline numbers of a grid as rows (section, name, value): presence, factors, self-consistency, prevalence.

    ``core`` has the cells at temperature 0, ``sampled`` those that were asked again at a higher one.
    """
    number = lambda df, section, names: df.select(F.explode(F.array(*(F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("r")).select("r.*")
    presence = number(metrics.krippendorff(core, ["speech_id"], "mentions_topic"), "presence", ("alpha", "mean_pairwise_agreement", "units"))
    factors = metrics.factor_decomposition(core, "speech_id", "mentions_topic").select(F.lit("factor").alias("section"), F.col("factor").alias("name"), F.col("disagreement").alias("value"))
    again = number(metrics.krippendorff(sampled, ["speech_id", "role", "task", "definition", "model_id"], "mentions_topic"), "self-consistency", ("alpha", "units"))
    spread = number(metrics.prevalence(core, list(metrics.FACTORS), "mentions_topic"), "prevalence", ("mean", "min", "max", "spread"))
    return presence.unionByName(factors).unionByName(again).unionByName(spread)


def spotcheck(drawn: DataFrame, cells: DataFrame) -> DataFrame:
    """Bands of a drawn check against the labels that were made for it: (band, n_speeches, n_labelled, rate, mean_score).

    ``drawn`` has speech_id, band and score; a speech that no cell labels counts in its band alone.
    """
    rates = cells.groupBy("speech_id").agg(F.avg(F.col("mentions_topic").cast("double")).alias("r")).filter("r is not null")
    return drawn.join(rates, "speech_id", "left").groupBy("band").agg(
        F.count("*").alias("n_speeches"), F.count("r").alias("n_labelled"), F.round(F.avg("r"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
