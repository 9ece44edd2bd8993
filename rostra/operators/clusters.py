"""Clusters: connected components of spellings, and average-linkage clusters of phrases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import names
from rostra.runtime import checkpointed

#: Phrases that one clustering takes; its matrix of distances is held by one task.
PHRASES = 20_000
#: Names of a block that are compared with each other in one task.
PART = 512


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components (node, component), the component named by its least node.

    Every node takes the least label among its neighbours and then the label of its label, so that chains shrink by half
    a round; labels are written out between rounds, until a round changes none.
    """
    both = checkpointed(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a")).distinct())
    labels = checkpointed(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node", "left").select("node", "component", F.least("component", F.coalesce("heard", F.col("component"))).alias("low"))
        far = near.join(labels.select(F.col("node").alias("low"), F.col("component").alias("root")), "low", "left")
        step = checkpointed(far.select("node", F.least("low", F.coalesce("root", F.col("low"))).alias("component"), F.col("component").alias("was")))
        labels = step.select("node", "component")
        if step.filter("component <> was").isEmpty():
            return labels


def alike(spellings: DataFrame, above: float) -> DataFrame:
    """Pairs (a, b) of spellings (name, block) of one block that are more alike than ``above``.

    A block is compared by parts of about ``PART`` names, so that a common sound is the work of many tasks, and in the JVM
    all but pairs that can be alike drop out: those with a word in common, or whose words in order are few edits apart.
    """
    sizes = spellings.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    words = F.array_sort(F.array_distinct(F.split("name", " ")))
    held = spellings.join(sizes, "block").select("block", "name", words.alias("w"), F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), "parts")
    left = held.select("block", F.col("name").alias("a"), F.col("w").alias("aw"), F.col("part").alias("low"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("high"))
    right = held.select("block", F.col("name").alias("b"), F.col("w").alias("bw"), F.explode(F.sequence(F.lit(0), "part")).alias("low"), F.col("part").alias("high"))
    pairs = left.join(right, ["block", "low", "high"]).filter("low < high or a < b")
    one, two = F.array_join("aw", " "), F.array_join("bw", " ")
    room = F.floor((F.length(one) + F.length(two)) * (1 - above / 100)).cast("int")
    can = F.arrays_overlap("aw", "bw") | (F.abs(F.length(one) - F.length(two)) <= room) & (F.levenshtein(one, two) <= room)
    near = pairs.filter(can).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.filter(names.name_similarity("a", "b") > above)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Rows with their number in an order, from 1 on: ranges of the order are numbered side by side, behind the counts of
    the ranges before them."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_c"))
    # A row for each range.
    before = counts.select("_range", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(before), "_range").withColumn(name, number).drop("_range", "_before")


def speakers(rows: DataFrame, above: float = 90.0) -> DataFrame:
    """Speakers from spellings (speaker, date): canonical_name, aliases, first, last, gap_days, n_variants, n_rows, person_id.

    Spellings are compared within blocks of sound; those more alike than ``above`` are one speaker, as are their chains.
    Empty names drop out. Ids follow the first date and the name.
    """
    cleaned = rows.select(names.clean_name(F.col("speaker")).alias("name"), F.try_to_date("date").alias("date")).filter("name <> ''")
    spellings = cleaned.groupBy("name").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n")).withColumn("block", names.block_key(F.col("name")))
    labels = components(alike(spellings.select("name", "block"), above), spellings.select(F.col("name").alias("node")))
    joined = spellings.join(labels, spellings.name == labels.node)
    best = F.max_by("name", F.struct(F.length("name"), F.transform(F.split("name", ""), lambda c: -F.ascii(c))))
    people = joined.groupBy("component").agg(
        best.alias("canonical_name"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("aliases"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.count("*").alias("n_variants"), F.sum("n").alias("n_rows"),
    )
    people = people.withColumn("gap_days", F.datediff("last", "first")).drop("component")
    return numbered(people, ["first", "canonical_name"], "_i").withColumn("person_id", F.concat(F.lit("P"), F.lpad(F.col("_i").cast("string"), 5, "0"))).drop("_i")


def average_linkage(vectors: np.ndarray, distance: float) -> np.ndarray:
    """Labels of agglomerative clusters, average linkage on cosine distance, cut at ``distance``."""
    n = len(vectors)
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12)
    gaps = 1.0 - unit @ unit.T
    np.fill_diagonal(gaps, np.inf)
    size, owner = np.ones(n), np.arange(n)
    nearest = gaps.argmin(axis=1) if n > 1 else np.zeros(n, int)
    while n > 1:
        i = int(gaps[np.arange(len(gaps)), nearest].argmin())
        j = int(nearest[i])
        if not gaps[i, j] <= distance:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * gaps[i] + size[j] * gaps[j]) / (size[i] + size[j])
        merged[[i, j]] = np.inf
        gaps[i], gaps[:, i] = merged, merged
        gaps[j], gaps[:, j] = np.inf, np.inf
        size[i] += size[j]
        owner[owner == j] = i
        touched = np.flatnonzero((nearest == i) | (nearest == j))
        nearest[touched] = gaps[touched].argmin(axis=1)
        closer = gaps[:, i] < gaps[np.arange(len(gaps)), nearest]
        nearest[closer] = i
        nearest[i] = gaps[i].argmin()
    return owner


def theme_clusters(phrases: DataFrame, distance: float = 0.35, least: int = 2) -> DataFrame:
    """Theme clusters of (arm, phrase, vector, speech_ids): arm, cluster, label, n_phrases, n_speeches, members.

    Each arm is clustered by one task over its distinct phrases, whose number is checked. Clusters below ``least`` phrases
    drop out; the label is the phrase nearest to the centre; the largest by speeches come first.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > PHRASES:
            raise ValueError(f"more than {PHRASES} phrases in one clustering")
        rows = rows.sort_values("phrase").reset_index(drop=True)
        vectors = np.stack([np.asarray(v, float) for v in rows["vector"]])
        out = []
        for _, g in rows.groupby(average_linkage(vectors, distance)):
            if len(g) < least:
                continue
            own = vectors[g.index]
            centre = own.mean(axis=0)
            sims = own @ centre / (np.linalg.norm(own, axis=1) * (np.linalg.norm(centre) + 1e-12) + 1e-12)
            out.append((g["phrase"].iloc[int(sims.argmax())], len(g), len({s for ids in g["speech_ids"] for s in ids}), "; ".join(g["phrase"])))
        out.sort(key=lambda x: (-x[2], -x[1], x[0]))
        return pd.DataFrame([(rows["arm"].iloc[0], i, *x) for i, x in enumerate(out)], columns=["arm", "cluster", "label", "n_phrases", "n_speeches", "members"])

    return phrases.groupBy("arm").applyInPandas(run, "arm string, cluster int, label string, n_phrases long, n_speeches long, members string")
