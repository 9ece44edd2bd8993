"""Time intervals for each entity: continuous periods and the gaps between them, merged on two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Years of a shard. An entity has at most so many rows in a shard after the local level.
SHARD = 32


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    """Merge overlapping or adjoining (a, b) within ``by``."""
    over = Window.partitionBy(*by).orderBy("a", "b")
    reach = F.max("b").over(over.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.withColumn("opens", F.when(reach >= F.col("a") - 1, 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("opens").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def periods_and_gaps(df: DataFrame, entity: Sequence[str | Column], start: str | Column, end: str | Column, shard: int = SHARD) -> DataFrame:
    """Periods and gaps of inclusive integer intervals: the entity's columns, kind ('period' or 'gap'), from_year, to_year.

    Rows with a null start or end, or an end before the start, are no intervals. Null entity values form an entity of
    their own. Repeated rows and ties change nothing, other columns are ignored, an empty table gives an empty one.

    An entity may hold any share of the rows. Each interval is clipped at shard bounds: what lies in the first and the
    last shard goes to these shards, whole shards in between stay one piece. Pieces of one start are folded to the
    longest while they are still on the map side, so a shard of an entity brings at most ``shard`` rows to its local
    merge, and the stitching window sees only merged coverage.
    """
    # Named apart from any input column; the selection leaves out the rest.
    keys = [f"entity_{i}" for i in range(len(entity))]
    names = [e if isinstance(e, str) else df.select(e).columns[0] for e in entity]
    cols = [F.col(e) if isinstance(e, str) else e for e in entity]
    rows = df.select(
        *(c.alias(k) for c, k in zip(cols, keys)),
        (F.col(start) if isinstance(start, str) else start).cast("long").alias("a"),
        (F.col(end) if isinstance(end, str) else end).cast("long").alias("b"),
    ).filter("a is not null and b is not null and a <= b")
    first, last, size = F.floor(F.col("a") / shard), F.floor(F.col("b") / shard), F.lit(shard)
    piece = lambda s, a, b: F.struct(s.cast("long").alias("shard"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    pieces = F.when(first == last, F.array(piece(first, F.col("a"), F.col("b")))).otherwise(
        F.array(
            piece(first, F.col("a"), (first + 1) * size - 1),
            piece(first + 1, (first + 1) * size, last * size - 1),
            piece(last, last * size, F.col("b")),
        )
    )
    clipped = rows.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*").filter("a <= b")
    folded = clipped.groupBy(*keys, "shard", "a").agg(F.max("b").alias("b"))
    local = _islands(folded, [*keys, "shard"]).select(*keys, "a", "b")
    merged = _islands(local, keys)
    after = Window.partitionBy(*keys).orderBy("a")
    out = merged.withColumn("next", F.lead("a").over(after)).select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("a").alias("f"), F.col("b").alias("t")),
                    F.struct(F.lit("gap").alias("kind"), (F.col("b") + 1).alias("f"), (F.col("next") - 1).alias("t")),
                ),
                lambda x: x["t"].isNotNull(),
            )
        ).alias("o"),
    )
    return out.select(
        *(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("o.kind").alias("kind"), F.col("o.f").cast("int").alias("from_year"), F.col("o.t").cast("int").alias("to_year")
    )


def party_periods(parties: DataFrame, open_end: int = 2025) -> DataFrame:
    """Membership periods and gaps by speaker and party: party trimmed and in lower case, a null end is ``open_end``."""
    party = F.lower(F.trim("party"))
    rows = parties.select("speaker_name", party.alias("party"), "start_year", F.coalesce("end_year", F.lit(open_end)).alias("end_year"))
    return periods_and_gaps(rows.filter("party <> ''"), ["speaker_name", "party"], "start_year", "end_year")


PARTY_PERIODS_SQL = """
WITH i AS (
  SELECT speaker_name, lower(trim(party)) AS party, start_year AS a, coalesce(end_year, 2025) AS b
  FROM speaker_parties_without_url
  WHERE trim(party) <> '' AND start_year IS NOT NULL AND coalesce(end_year, 2025) >= start_year
), o AS (
  SELECT *, CASE WHEN max(b) OVER (PARTITION BY speaker_name, party ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a - 1 THEN 0 ELSE 1 END AS opens FROM i
), r AS (
  SELECT *, sum(opens) OVER (PARTITION BY speaker_name, party ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM o
), p AS (
  SELECT speaker_name, party, min(a) AS a, max(b) AS b FROM r GROUP BY speaker_name, party, run
), g AS (
  SELECT *, lead(a) OVER (PARTITION BY speaker_name, party ORDER BY a) AS nxt FROM p
)
SELECT speaker_name, party, 'period' AS kind, a AS from_year, b AS to_year FROM g
UNION ALL
SELECT speaker_name, party, 'gap', b + 1, nxt - 1 FROM g WHERE nxt IS NOT NULL
"""
