"""Ranking evaluation and agreement metrics in closed form, as grouped aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.operators.strata import first_of_each

#: Bands of scores that running sums are worked out in.
BANDS = 1024
FACTORS = ("role", "task", "output_format", "model_id")
THRESHOLDS = [i / 20 for i in range(4, 17)]


def core_grid(df: DataFrame) -> DataFrame:
    """Cells at temperature 0 of the capped tasks and the current definition, as far as these columns exist."""
    keep = F.lit(True)
    if "condition" in df.columns:
        keep &= F.col("condition").eqNullSafe("temp0")
    if "task" in df.columns:
        keep &= ~F.col("task").eqNullSafe("v1_nocap")
    if "definition" in df.columns:
        keep &= F.col("definition").eqNullSafe("current")
    return df.filter(keep)


def unit_counts(df: DataFrame, unit: Sequence[str], rating: str) -> DataFrame:
    """Counts of ratings for each unit: m ratings, yes and no; null ratings do not count."""
    yes = F.sum(F.col(rating).cast("long"))
    return df.groupBy(*unit).agg(F.count(rating).alias("m"), F.coalesce(yes, F.lit(0)).alias("yes")).withColumn("no", F.col("m") - F.col("yes"))


def disagreement() -> Column:
    """Chance that two ratings of a unit differ; null below two."""
    same = F.col("yes") * (F.col("yes") - 1) + F.col("no") * (F.col("no") - 1)
    return F.when(F.col("m") >= 2, 1 - same / (F.col("m") * (F.col("m") - 1)))


def krippendorff(df: DataFrame, unit: Sequence[str], rating: str, group: Sequence[str] = ()) -> DataFrame:
    """Nominal alpha of a boolean rating, mean pairwise agreement, number of units and median raters.

    Null where no unit has two ratings, 1 where all ratings are alike.
    """
    u = unit_counts(df, [*group, *unit], rating).filter("m >= 2")
    same = (F.col("yes") * (F.col("yes") - 1) + F.col("no") * (F.col("no") - 1)) / (F.col("m") - 1)
    sums = u.groupBy(*group).agg(
        F.sum("m").alias("n"), F.sum(same).alias("same"), F.sum("yes").alias("y"), F.sum("no").alias("z"),
        F.avg(1 - disagreement()).alias("agreement"), F.count("*").alias("units"), F.percentile("m", F.lit(0.5)).alias("raters"),
    )
    expected = (F.col("n") * F.col("n") - F.col("y") * F.col("y") - F.col("z") * F.col("z")) / (F.col("n") - 1)
    alpha = F.when(F.col("n") >= 2, F.when(expected == 0, 1.0).otherwise(1 - (F.col("n") - F.col("same")) / expected))
    return sums.select(*group, F.round(alpha, 4).alias("alpha"), F.round("agreement", 4).alias("mean_pairwise_agreement"), "units", "raters")


def factor_decomposition(df: DataFrame, unit: str, rating: str, factors: Sequence[str] = FACTORS) -> DataFrame:
    """Mean disagreement that each factor makes while speech and the other factors stay, largest first."""
    out = None
    for factor in factors:
        others = [unit, *(f for f in factors if f != factor)]
        rows = df.filter(F.expr(" and ".join(f"{c} is not null" for c in others)))
        part = unit_counts(rows, others, rating).agg(F.round(F.avg(disagreement()), 6).alias("disagreement")).withColumn("factor", F.lit(factor))
        levels = df.agg(F.countDistinct(factor).alias("n_levels"))
        part = part.crossJoin(levels).select("factor", "disagreement", "n_levels")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("disagreement"), "factor")


def prevalence(df: DataFrame, cell: Sequence[str], rating: str) -> DataFrame:
    """Mean, least, greatest, deviation and spread of the share of positive ratings over cells."""
    cells = df.groupBy(*cell).agg(F.avg(F.col(rating).cast("double")).alias("p")).filter("p is not null")
    r = lambda c, name: F.round(c, 6).alias(name)
    return cells.agg(r(F.avg("p"), "mean"), r(F.min("p"), "min"), r(F.max("p"), "max"), r(F.stddev_samp("p"), "sd"), r(F.max("p") - F.min("p"), "spread"), F.count("*").alias("cells"))


def gold(df: DataFrame, least: int, group: Sequence[str] = ()) -> DataFrame:
    """Majority label of each speech: rate, n and label, a tie positive, speeches below ``least`` votes left out."""
    out = df.groupBy(*group, "speech_id").agg(F.avg(F.col("mentions_topic").cast("double")).alias("rate"), F.count("mentions_topic").alias("n"))
    return out.filter(F.col("n") >= least).withColumn("label", (F.col("rate") >= 0.5).cast("int")).withColumn("rate", F.round("rate", 6))


def votes(df: DataFrame) -> DataFrame:
    """Cells that count as a vote: temperature 0, JSON, parsed, not inferred."""
    return df.filter((F.col("condition") == "temp0") & (F.col("output_format") == "json") & F.col("parse_ok") & ~F.coalesce("presence_inferred", F.lit(False)))


def leave_one_out(df: DataFrame, by: str, least: int) -> DataFrame:
    """Gold for every value of ``by`` from the cells of all other values, in one pass: totals less the value's own part."""
    held = df.filter(F.col("mentions_topic").isNotNull()).groupBy("speech_id", by).agg(F.count("*").alias("n"), F.sum(F.col("mentions_topic").cast("long")).alias("y"))
    total = held.groupBy("speech_id").agg(F.sum("n").alias("all_n"), F.sum("y").alias("all_y"))
    values = df.select(by).filter(F.col(by).isNotNull()).distinct()
    rest = total.crossJoin(F.broadcast(values)).join(held, ["speech_id", by], "left").select(
        by, "speech_id", (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("all_y") - F.coalesce("y", F.lit(0))).alias("y")
    )
    rate = F.col("y") / F.col("n")
    return rest.filter(F.col("n") >= least).select(by, "speech_id", F.round(rate, 6).alias("rate"), "n", (rate >= 0.5).cast("int").alias("label"))


def model_agreement(df: DataFrame, least: int) -> DataFrame:
    """Share of equal verdicts of two models over the speeches that both judged, at least ``least`` of them."""
    one = df.filter("mentions_topic is not null").groupBy("speech_id", "model_id").agg(F.min_by("mentions_topic", "ord").alias("v"))
    a, b = one.alias("a"), one.alias("b")
    pairs = a.join(b, (F.col("a.speech_id") == F.col("b.speech_id")) & (F.col("a.model_id") < F.col("b.model_id")))
    out = pairs.groupBy(F.col("a.model_id").alias("model_a"), F.col("b.model_id").alias("model_b"))
    return out.agg(F.count("*").alias("n"), F.round(F.avg((F.col("a.v") == F.col("b.v")).cast("double")), 6).alias("agreement")).filter(F.col("n") >= least)


def determinism(df: DataFrame, cell: Sequence[str], text: str, rating: str, model: str) -> DataFrame:
    """Per model, the share of repeated cells whose texts, and whose labels, are all the same; null is a value."""
    same = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) == 1).cast("double")
    cells = df.groupBy(*cell).agg(F.count("*").alias("n"), same(text).alias("bytes"), same(rating).alias("labels")).filter("n >= 2")
    return cells.groupBy(model).agg(F.count("*").alias("cells"), F.round(F.avg("bytes"), 6).alias("byte_identical"), F.round(F.avg("labels"), 6).alias("label_stable"))


def _running(s: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """Counts (n, tp) of each score with the sums below it (n_below, tp_below) and of its group (all_n, all_tp).

    Scores are cut into bands of equal width: sums run within a band and over the short table of bands, so a ranking of
    any length is no single task.
    """
    edge = s.groupBy(*group).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    band = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BANDS)).otherwise(0)
    s = s.join(edge, list(group)).withColumn("_band", band).drop("_lo", "_hi")
    bands = s.groupBy(*group, "_band").agg(F.sum("n").alias("_n"), F.sum("tp").alias("_tp"))
    per = Window.partitionBy(*group)
    under = per.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    bands = bands.select(*group, "_band", zero(F.sum("_n").over(under)).alias("_un"), zero(F.sum("_tp").over(under)).alias("_utp"), F.sum("_n").over(per).alias("all_n"), F.sum("_tp").over(per).alias("all_tp"))
    local = Window.partitionBy(*group, "_band").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    out = s.join(bands, [*group, "_band"])
    return out.withColumns({"n_below": F.col("_un") + zero(F.sum("n").over(local)), "tp_below": F.col("_utp") + zero(F.sum("tp").over(local))}).drop("_band", "_un", "_utp")


def ranking(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """AUROC by average ranks and average precision by distinct scores, for every group that has both classes."""
    s = df.groupBy(*group, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("tp"))
    s = _running(s, group, score).withColumns({"pos": F.col("all_tp"), "neg": F.col("all_n") - F.col("all_tp")}).filter("pos > 0 and neg > 0")
    rank = F.col("n_below") + (F.col("n") + 1) / 2
    ctp, cn = F.col("all_tp") - F.col("tp_below"), F.col("all_n") - F.col("n_below")
    out = s.groupBy(*group, "pos", "neg").agg(F.sum(rank * F.col("tp")).alias("r"), F.sum(F.col("tp") / F.col("pos") * ctp / cn).alias("ap"))
    auc = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return out.select(*group, F.round(auc, 6).alias("auroc"), F.round("ap", 6).alias("ap"), F.col("pos").alias("positives"), F.col("neg").alias("negatives"))


def at_k(df: DataFrame, group: Sequence[str], score: str, label: str, key: str, ks: Sequence[int]) -> DataFrame:
    """Precision and recall of the first k by score, ties by key."""
    positives = df.groupBy(*group).agg(F.sum(F.col(label).cast("long")).alias("P"))
    first = first_of_each(df, group, [F.desc(score), F.col(key)], key, max(ks), "r")
    cut = first.withColumn("k", F.explode(F.lit(list(ks)))).filter("r <= k")
    out = cut.groupBy(*group, "k").agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count("*").alias("n")).join(positives, list(group))
    return out.select(*group, "k", F.round(F.col("hits") / F.col("n"), 6).alias("precision"), F.round(F.when(F.col("P") > 0, F.col("hits") / F.col("P")), 6).alias("recall"))


def sweep(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Retained share, precision and recall at each threshold of the grid."""
    grid = df.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(4), F.lit(16)), lambda i: i / F.lit(20.0))))
    kept = (F.col(score) >= F.col("threshold")).cast("long")
    hit = kept * F.col(label).cast("long")
    out = grid.groupBy(*group, "threshold").agg(F.count("*").alias("n"), F.sum(kept).alias("kept"), F.sum(hit).alias("hits"), F.sum(F.col(label).cast("long")).alias("P"))
    return out.select(
        *group, "threshold", F.round(F.col("kept") / F.col("n"), 6).alias("retained"),
        F.round(F.when(F.col("kept") > 0, F.col("hits") / F.col("kept")), 6).alias("precision"), F.round(F.when(F.col("P") > 0, F.col("hits") / F.col("P")), 6).alias("recall"),
    )


def baseline(df: DataFrame, flag: str, label: str) -> DataFrame:
    """Precision and recall of a flag as a classifier."""
    f, y = F.col(flag).cast("long"), F.col(label).cast("long")
    s = df.agg(F.sum(f * y).alias("tp"), F.sum(f).alias("p"), F.sum(y).alias("y"))
    return s.select(F.round(F.when(F.col("p") > 0, F.col("tp") / F.col("p")), 6).alias("precision"), F.round(F.when(F.col("y") > 0, F.col("tp") / F.col("y")), 6).alias("recall"))


def rank_agreement(df: DataFrame, key: str, by: str, score: str, k: int) -> DataFrame:
    """Spearman correlation and overlap of the first k for each pair of rankings, over keys that all rankings hold.

    Ranks come from running sums over bands and the first k from draws in parts, so that no ranking is one task.
    """
    whole = df.filter(F.col(score).isNotNull()).select(key, by, score)
    total = whole.agg(F.count_distinct(by).alias("models"))
    held = whole.groupBy(key).agg(F.count_distinct(by).alias("have")).crossJoin(F.broadcast(total)).filter("have = models").select(key)
    full = whole.join(held, key)
    tied = _running(full.groupBy(by, score).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("tp")), [by], score)
    ranks = tied.select(by, score, (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"))
    first = first_of_each(full, [by], [F.desc(score), F.col(key)], key, k, "_r").select(key, by, F.lit(1).alias("top"))
    placed = full.join(ranks, [by, score]).join(first, [key, by], "left").select(key, by, "rank", F.coalesce("top", F.lit(0)).alias("top"))
    a, b = placed.alias("a"), placed.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{by}") < F.col(f"b.{by}")))
    return pairs.groupBy(F.col(f"a.{by}").alias("a"), F.col(f"b.{by}").alias("b")).agg(
        F.round(F.corr("a.rank", "b.rank"), 6).alias("spearman"), F.round(F.sum(F.col("a.top") * F.col("b.top")) / k, 6).alias("overlap"), F.count("*").alias("n")
    )


def length_bias(df: DataFrame, group: Sequence[str], score: str, words: str) -> DataFrame:
    """Correlation of the score with the logarithm of the length."""
    return df.groupBy(*group).agg(F.round(F.corr(score, F.log(F.greatest(F.col(words), F.lit(1)).cast("double"))), 6).alias("length_corr"), F.count("*").alias("n"))


def format_effect(df: DataFrame) -> DataFrame:
    """Rates by output format: all parsed cells, those that the model stated, what the parser inferred, and failures."""
    ok, inferred = F.col("parse_ok"), F.coalesce("presence_inferred", F.lit(False))
    yes = F.col("mentions_topic").cast("double")
    return df.groupBy("output_format").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(ok, yes)), 6).alias("raw_rate"), F.round(F.avg(F.when(ok & ~inferred, yes)), 6).alias("stated_rate"),
        F.round(F.avg(F.when(ok, inferred.cast("double"))), 6).alias("inferred_share"), F.round(F.avg((~ok).cast("double")), 6).alias("fail_share"),
    )


def cap_effect(df: DataFrame, cell: Sequence[str], task: str, capped, free, count: str) -> DataFrame:  # noqa: ANN001
    """Per speech, the mean of capped less uncapped theme counts over cells that have both."""
    cells = df.filter(F.col(task).isin(capped, free)).groupBy("speech_id", *cell).agg(
        F.avg(F.when(F.col(task) == capped, F.col(count))).alias("c"), F.avg(F.when(F.col(task) == free, F.col(count))).alias("u")
    )
    both = cells.filter("c is not null and u is not null")
    return both.groupBy("speech_id").agg(F.round(F.avg(F.col("c") - F.col("u")), 6).alias("cap_effect"), F.count("*").alias("cells"))


def definition_split(df: DataFrame, by: str) -> DataFrame:
    """Per speech, the vote rate of each definition's most divided one: 2 min(r, 1 - r), and the widest gap of rates."""
    rates = df.filter("mentions_topic is not null").groupBy("speech_id", by).agg(F.avg(F.col("mentions_topic").cast("double")).alias("r"))
    return rates.groupBy("speech_id").agg(
        F.round(F.max(2 * F.least(F.col("r"), 1 - F.col("r"))), 6).alias("split"), F.round(F.max("r") - F.min("r"), 6).alias("gap"), F.count("*").alias("definitions")
    )


def masked_rate(df: DataFrame, group: Sequence[str] = (), mask: Column | None = None) -> DataFrame:
    """Positives, parsed cells and their share; positives are the affirmed topic, or the rows of a mask."""
    hit = F.coalesce(F.col("mentions_topic") if mask is None else mask, F.lit(False)).cast("long")
    out = df.filter(F.col("parse_ok")).groupBy(*group).agg(F.coalesce(F.sum(hit), F.lit(0)).alias("positives"), F.count("*").alias("parsed"))
    return out.withColumn("share", F.round(F.try_divide("positives", "parsed"), 6))


def queries_gold(panel: DataFrame, pilot: DataFrame, queries: DataFrame, least: int = 3) -> DataFrame:
    """Labels for each query (query_id, speech_id, label): the panel's majority without the query's own definition.

    Queries of no panel definition take the whole panel. Without any panel cell, the pilot's majority under the query's
    definition stands in, or under the pilot's first definition where it has none.
    """
    if panel.isEmpty():
        known = pilot.select("definition").distinct()
        own = queries.join(known, queries.query_id == known.definition, "left")
        fallback = pilot.agg(F.min("definition").alias("_any"))
        named = own.crossJoin(F.broadcast(fallback)).select("query_id", F.coalesce("definition", "_any").alias("definition"))
        labels = gold(pilot, 1, ["definition"]).select("definition", "speech_id", "label")
        return named.join(labels, "definition").select("query_id", "speech_id", "label")
    held = votes(panel)
    own = leave_one_out(held, "definition", least).select(F.col("definition").alias("query_id"), "speech_id", "label")
    names = held.select(F.col("definition").alias("query_id")).distinct()
    rest = queries.select("query_id").join(names, "query_id", "left_anti").crossJoin(gold(held, least).select("speech_id", "label"))
    return own.join(queries.select("query_id").distinct(), "query_id", "left_semi").unionByName(rest)


def evaluate_all(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Every query and mode of the scores against the query's own labels: (query_id, mode, auroc, ap, positives, negatives)."""
    return ranking(scores.join(labels, ["query_id", "speech_id"]), ["query_id", "mode"], "score", "label")
