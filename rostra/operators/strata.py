"""Sampling by strata. Draws are ordered by a salted MD5 of the key, so they repeat on any layout and in any engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group is ranked in before its best rows meet.
PARTS = 64


def draw_order(key: str, seed: int) -> Column:
    """Sort key of a draw."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def first_of_each(df: DataFrame, groups: Sequence[str], order: Sequence[Column], key: str, size: int | Column, rank: str = "draw") -> DataFrame:
    """The first ``size`` rows of each group in an order, with their rank; groups may be of any size.

    A group is ranked in ``PARTS`` parts first, each of which can only bring ``size`` rows, and these are ranked together.
    """
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    local = df.withColumn("_part", part)
    local = local.withColumn(rank, F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))).filter(F.col(rank) <= size).drop("_part", rank)
    return local.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= size)


def _joined(df: DataFrame, counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on keys of which null equals null."""
    other = counts.select(*(F.col(c).alias(f"_{c}") for c in on), *(c for c in counts.columns if c not in on))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(other, cond, "left").drop(*(f"_{c}" for c in on))


def stratified(df: DataFrame, strata: Sequence[str], key: str, size: Column | int, seed: int) -> DataFrame:
    """Up to ``size`` rows of each stratum with cell_pop, cell_n and sampling_weight; null strata are strata too.

    Populations are counted with partial sums and draws are ranked in parts, so a stratum may hold most of the corpus; the
    weight is the population over what was drawn.
    """
    pops = df.groupBy(*strata).agg(F.count("*").alias("cell_pop"))
    kept = first_of_each(df, strata, [draw_order(key, seed), F.col(key)], key, size).drop("draw")
    kept = kept.withColumn("cell_n", F.count("*").over(Window.partitionBy(*strata)))
    return _joined(kept, pops, strata).withColumn("sampling_weight", F.col("cell_pop") / F.col("cell_n"))


def proportional(df: DataFrame, stratum: str, key: str, target: int, floor: int, seed: int) -> DataFrame:
    """Strata in proportion to their size, with a floor: stratum_pop and sampling_weight come along."""
    pops = df.groupBy(stratum).agg(F.count("*").alias("stratum_pop"))
    # One row for each stratum: the total is a window over that small table.
    total = Window.partitionBy()
    share = pops.withColumn("quota", F.least("stratum_pop", F.greatest(F.lit(floor), F.bround(F.lit(float(target)) * F.col("stratum_pop") / F.sum("stratum_pop").over(total), 0)).cast("long")))
    ranked = first_of_each(_joined(df, share, [stratum]), [stratum], [draw_order(key, seed), F.col(key)], key, F.col("quota"))
    return ranked.withColumn("sampling_weight", F.col("stratum_pop") / F.col("quota")).drop("draw", "quota")


def balanced(df: DataFrame, stratum: str, strata: int, key: str, size: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """An equal draw from every stratum, less the excluded keys, topped up from the whole pool to ``size`` rows."""
    order = [draw_order(key, seed), F.col(key)]
    first = first_of_each(df.select(key, stratum), [stratum], order, key, size // strata).select(key, F.lit(0).alias("turn"), draw_order(key, seed).alias("at"))
    # A top-k by sort order, not a window over everything.
    more = df.orderBy(draw_order(key, seed + 1), key).limit(2 * size).select(key, F.lit(1).alias("turn"), draw_order(key, seed + 1).alias("at"))
    drawn = first.unionByName(more)
    if exclude is not None:
        drawn = drawn.join(exclude.select(key).distinct(), key, "left_anti")
    picked = drawn.groupBy(key).agg(F.min(F.struct("turn", "at")).alias("place")).orderBy("place", key).limit(size).select(key)
    return df.join(F.broadcast(picked), key, "left_semi")


def systematic(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Every k-th row in a stated order, ``size`` rows at most; the frame is a drawn sample, not the corpus."""
    over = Window.orderBy(*order)
    placed = df.withColumns({"i": F.row_number().over(over) - 1, "n": F.count("*").over(Window.partitionBy())})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / size))
    return placed.filter((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < size)).drop("i", "n")


def bands(df: DataFrame, group: Sequence[str], score: str, key: str, size: int, seed: int) -> DataFrame:
    """Top, bottom and a random middle of every ranking, as ``band``; a row is in the first band that takes it.

    Each band is a draw of its own in parts, so a ranking may hold all documents.
    """
    top = first_of_each(df, group, [F.desc(score), F.col(key)], key, size).drop("draw").withColumn("band", F.lit("top"))
    low = first_of_each(df, group, [F.asc(score), F.desc(key)], key, size).drop("draw").withColumn("band", F.lit("bottom"))
    mid = first_of_each(df, group, [draw_order(key, seed), F.col(key)], key, 3 * size).withColumn("band", F.lit("mid"))
    # Of three times the size drawn, at most two thirds are in the other bands.
    every = top.withColumn("draw", F.lit(0)).unionByName(low.withColumn("draw", F.lit(0))).unionByName(mid)
    turn = F.when(F.col("band") == "top", 0).when(F.col("band") == "bottom", 1).otherwise(2)
    once = every.withColumn("_n", F.row_number().over(Window.partitionBy(*group, key).orderBy(turn))).filter("_n = 1").drop("_n")
    pick = F.row_number().over(Window.partitionBy(*group, "band").orderBy("draw", key))
    return once.withColumn("_pick", pick).filter((F.col("band") != "mid") | (F.col("_pick") <= size)).drop("_pick", "draw")


def verification(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Up to ``size`` keys for a check by hand, drawn without replacement: each once, null none."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(draw_order(key, seed), key).limit(size)
