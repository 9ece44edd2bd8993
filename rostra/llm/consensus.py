"""Consensus of several annotators by spectral reliability.

The chance-centred agreement of two annotators is the product of their reliabilities, so the leading eigenvector of the
agreement matrix gives the reliabilities. The votes are paired once, item by item, into the sums and overlaps of annotator
pairs; the power iteration then runs as sparse joins over that table alone, however many votes there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostra.runtime import checkpointed, sized

#: Rounds of the power iteration in one job, the most of them in all, and the change of the vector at which it has converged.
ROUNDS, MOST, CHANGE = 6, 300, 1e-5
#: Common items that the present fit counts for in a pair, so that a chance overlap of a few says little.
HOLD = 10.0
#: Rates of an annotator stay within these, so that no annotator decides an item alone.
FLOOR = 0.03
#: Annotators up to which their rates and weights are sent to every task; joined beyond.
ANNOTATORS = 10_000
#: Entries of the agreement matrix up to which it is held as one partition.
ENTRIES = 200_000


def grouped(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes (item, annotator, value) by annotator and by item: (annotator, i, rate, n), i counting annotators from 1, and
    (item, v), v an array of an item's votes as (i, x, value), x centred on the annotator's rate.

    An item has one vote of each annotator, which bounds its array, however often it was judged.
    """
    rates = votes.groupBy("annotator").agg(F.avg("value").alias("rate"), F.count("*").alias("n"))
    # A row for each annotator.
    stats = checkpointed(rates.withColumn("i", F.row_number().over(Window.orderBy("annotator"))))
    seen = votes.join(sized(stats.select("annotator", "i", "rate"), ANNOTATORS), "annotator").select("item", F.struct("i", (F.col("value") - F.col("rate")).alias("x"), "value").alias("v"))
    return stats, checkpointed(seen.groupBy("item").agg(F.collect_list("v").alias("v")))


def agreement_pairs(stats: DataFrame, items: DataFrame) -> DataFrame:
    """The chance-centred agreement matrix, both halves and an empty diagonal: (a, b, c, n), c the sum of products over the
    n common items. The pairs of an item are at most those of the matrix; their sums are partial on the map side."""
    other = lambda x: F.transform(F.filter("v", lambda y: y["i"] > x["i"]), lambda y: F.struct(x["i"].alias("a"), y["i"].alias("b"), (x["x"] * y["x"]).alias("c")))
    half = items.select(F.explode(F.flatten(F.transform("v", other))).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.c").alias("c"), F.count("*").alias("n"))
    half = checkpointed(half)
    diagonal = stats.select(F.col("i").alias("a"), F.col("i").alias("b"), F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("n"))
    matrix = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "c", "n")).unionByName(diagonal)
    # A small matrix is one partition, which its rounds then need no shuffle for.
    return matrix.coalesce(1) if half.count() <= ENTRIES else matrix


def _step(pairs: DataFrame, vector: DataFrame) -> DataFrame:
    """One power step on vector (a, v, size, was), v of length 1 and size the eigenvalue.

    A pair's entry is its agreement over its overlap, held by the fit ``size * v_a * v_b``; where nobody overlaps, as on the
    diagonal, the entry is the fit itself. All fits together give ``size * v_a``, so only pairs that overlap are joined.
    """
    u = F.col("v")
    sums = pairs.join(vector.withColumnRenamed("a", "b"), "b").groupBy("a").agg(
        F.sum(F.col("c") / (F.col("n") + HOLD) * u).alias("seen"), F.sum(F.col("n") / (F.col("n") + HOLD) * u * u).alias("part"),
        F.max(F.when(F.col("a") == F.col("b"), u)).alias("was"), F.max("size").alias("size"),
    )
    y = F.col("seen") + F.col("size") * F.col("was") * (1 - F.col("part"))
    # The vector has a row for each annotator.
    norm = F.sqrt(F.sum(F.col("y") * F.col("y")).over(Window.partitionBy()))
    out = sums.select("a", "was", y.alias("y")).withColumn("size", norm)
    return out.select("a", F.when(F.col("size") > 0, F.col("y") / F.col("size")).otherwise(0.0).alias("v"), "size", "was")


def _reliability(stats: DataFrame, items: DataFrame) -> DataFrame:
    pairs = agreement_pairs(stats, items)
    count = stats.count()
    vector = stats.select(F.col("i").alias("a"), F.lit(count**-0.5 if count else 0.0).alias("v"), F.lit(0.09 * count).alias("size"), F.lit(0.0).alias("was"))
    vector = vector.coalesce(1) if count <= ANNOTATORS else vector
    for _ in range(0, MOST, ROUNDS):
        for _ in range(ROUNDS):
            vector = _step(pairs, vector)
        vector = checkpointed(vector)
        change = vector.agg(F.max(F.abs(F.col("v") - F.col("was")))).first()[0]
        if not change or change < CHANGE:
            break
    else:
        raise ArithmeticError(f"no eigenvector after {MOST} rounds")
    # An eigenvector has no sign of its own: most votes are taken to be honest.
    fitted = vector.select(F.col("a").alias("i"), (F.col("v") * F.sqrt("size")).alias("w")).join(stats, "i")
    sign = fitted.agg(F.when(F.sum(F.col("w") * F.col("n")) < 0, -1.0).otherwise(1.0).alias("sign"))
    return fitted.crossJoin(F.broadcast(sign)).select("annotator", "i", (F.col("w") * F.col("sign")).alias("alpha"), "rate", "n")


def reliability(votes: DataFrame) -> DataFrame:
    """Reliability of annotators from votes (item, annotator, value in [0, 1]): (annotator, alpha, rate, n).

    ``alpha``, the eigenvector scaled by the root of its eigenvalue, is proportional to sensitivity + specificity - 1: about
    0 for one who guesses or always says the same, below 0 for one who is mostly wrong. ``rate`` is the share of positive
    votes, ``n`` the number of items. A power iteration that does not converge is an error.
    """
    return _reliability(*grouped(votes)).drop("i")


def _scored(items: DataFrame, annotators: DataFrame, share: float, few: bool) -> DataFrame:
    """Posterior of each item, if a share of the items is positive: (item, p, agreement).

    The weights of few annotators go to every task as an array, and an item is scored where it lies; those of more are joined.
    """
    clip = lambda c: F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), c))
    alpha = F.col("alpha") / (share * (1 - share)) ** 0.5
    hit, false = clip(F.col("rate") + alpha * (1 - share)), clip(F.col("rate") - alpha * share)
    weights = annotators.select("i", F.log(hit / false).alias("yes"), F.log((1 - hit) / (1 - false)).alias("no"))
    said = lambda value, yes, no: value * yes + (1 - value) * no
    if few:
        table = weights.agg(F.sort_array(F.collect_list(F.struct("i", "yes", "no"))).alias("w"))
        of = lambda x: said(x["value"], F.element_at("w", x["i"])["yes"], F.element_at("w", x["i"])["no"])
        scores = items.crossJoin(F.broadcast(table)).select("item", F.transform("v", of).alias("s"))
        total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
        out = scores.select("item", total(lambda x: x).alias("score"), total(F.abs).alias("size"))
    else:
        one = items.select("item", F.explode("v").alias("x")).join(weights, F.col("x.i") == F.col("i")).select("item", said(F.col("x.value"), F.col("yes"), F.col("no")).alias("s"))
        out = one.groupBy("item").agg(F.sum("s").alias("score"), F.sum(F.abs("s")).alias("size"))
    p = 1 / (1 + F.exp(-(F.col("score") + F.log(F.lit(share / (1 - share))))))
    return out.select("item", p.alias("p"), F.when(F.col("size") > 0, F.abs(F.col("score")) / F.col("size")).otherwise(0.0).alias("agreement"))


def consensus(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consensus of votes (item, annotator, value): items (item, p, agreement, label) and annotators (see `reliability`).

    ``p`` is the posterior of a positive label, ``agreement`` the share by which the weighed votes lean to one side.
    """
    stats, items = grouped(votes)
    annotators = checkpointed(_reliability(stats, items))
    few = stats.count() <= ANNOTATORS
    share = 0.5
    for _ in range(3):
        mean = _scored(items, annotators, share, few).agg(F.avg("p")).first()[0]
        share = min(0.95, max(0.05, mean if mean is not None else 0.5))
    return _scored(items, annotators, share, few).withColumn("label", F.col("p") > 0.5), annotators.drop("i")


def calls(df: DataFrame) -> DataFrame:
    """One row for each call: (call_id, item, annotator, verdict, themes); the latest row of a call_id holds.

    Rows without a speech or an annotator are left out; rows without a call_id count once for a speech and annotator.
    """
    theme = lambda x: F.lower(F.trim(x))
    themes = F.array_distinct(F.filter(F.transform(F.coalesce("subthemes", F.array().cast("array<string>")), theme), lambda x: x.isNotNull() & (x != "")))
    held = F.struct(F.col("ts").alias("ts"), F.col("mentions_topic").alias("verdict"), F.array_sort(themes).alias("themes"))
    rows = df.select("call_id", F.col("speech_id").alias("item"), F.col("model_id").alias("annotator"), held.alias("held"))
    rows = rows.filter("item is not null and annotator is not null")
    return rows.groupBy("call_id", "item", "annotator").agg(F.max("held").alias("held")).select("call_id", "item", "annotator", "held.verdict", "held.themes")


def verdict_votes(one: DataFrame) -> DataFrame:
    """Votes on the topic; an annotator that was asked more than once on a speech votes with the mean."""
    return one.filter("verdict is not null").groupBy("item", "annotator").agg(F.avg(F.col("verdict").cast("double")).alias("value"))


def theme_votes(one: DataFrame, positive: DataFrame) -> DataFrame:
    """Votes on themes: items are (speech, theme) that anyone named, votes come from all who found the topic there."""
    said = one.filter("verdict").join(positive, "item", "left_semi")
    asked = said.groupBy("item", "annotator").agg(F.count("*").alias("asked"))
    named = said.select("item", "annotator", F.explode("themes").alias("theme")).groupBy("item", "annotator", "theme").agg(F.count("*").alias("named"))
    # One row for a speech and theme, so that a speech with any number of calls stays as small as its themes.
    themes = named.select("item", "theme").distinct()
    grid = asked.join(themes, "item")
    votes = grid.join(named, ["item", "annotator", "theme"], "left")
    return votes.select(F.struct("item", "theme").alias("item"), "annotator", (F.coalesce("named", F.lit(0)) / F.col("asked")).alias("value"))


def topic_consensus(extraction: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consensus of topic and themes: labels (speech_id, label, p, agreement), topic annotators and theme annotators.

    Null verdicts are no votes; a speech without any vote has no label. Theme labels are trimmed and in lower case.
    Repeated rows, extra columns and empty tables change nothing or give empty results.
    """
    one = checkpointed(calls(extraction))
    votes = checkpointed(verdict_votes(one))
    topics, annotators = consensus(votes)
    topics = checkpointed(topics)
    positive = topics.filter("label").select("item")
    on_themes = checkpointed(theme_votes(one, positive))
    themes, theme_annotators = consensus(on_themes)
    label = lambda name: [name.alias("label"), "p", "agreement"]
    labels = topics.filter("label").select(F.col("item").alias("speech_id"), *label(F.lit("mentions_topic")))
    labels = labels.unionByName(themes.filter("label").select(F.col("item.item").alias("speech_id"), *label(F.col("item.theme"))))
    return labels, annotators, theme_annotators


def found(extraction: DataFrame) -> DataFrame:
    """The consensus labels alone: (speech_id, label)."""
    return topic_consensus(extraction)[0].select("speech_id", "label")


def worth(extraction: DataFrame) -> DataFrame:
    """Reliability of each annotator on the topic and on themes: (model_id, topic_alpha, theme_alpha, topic_rate, n)."""
    _, topic, theme = topic_consensus(extraction)
    return topic.join(theme.select("annotator", F.col("alpha").alias("theme_alpha")), "annotator", "left").select(
        F.col("annotator").alias("model_id"), F.round("alpha", 4).alias("topic_alpha"), F.round("theme_alpha", 4).alias("theme_alpha"), F.round("rate", 4).alias("topic_rate"), "n"
    )
