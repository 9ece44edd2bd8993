"""A reproducible sample that stays as the data grows: a salted hash of the record key against the sampling rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "rostra-sample-1"
#: Leading hexadecimal digits of the hash that make the unit interval; 13 are exact in a double.
DIGITS = 13
#: Sampling rates by seed_present; everything else is drawn at ``RATE``.
RATES, RATE = {True: 0.2, False: 0.1}, 0.1


def unit(key: Column, salt: str = SALT) -> Column:
    """The place of a key in [0, 1): the same in every engine that has MD5."""
    digest = F.substring(F.md5(F.concat(F.lit(salt + "|"), key.cast("string"))), 1, DIGITS)
    return F.conv(digest, 16, 10).cast("double") / float(16**DIGITS)


def stable_sample(df: DataFrame, key: str, delivery: str, fields: Sequence[str], rate: Column, salt: str = SALT) -> DataFrame:
    """One row (``key``, ``fields``, place) for each sampled key.

    A key is in if its place lies below ``rate``, which may depend on ``fields``. These hold the values of the earliest
    delivery, so rows of later deliveries, repeated or contradictory, change neither the fields nor the membership;
    contradictions within one delivery are settled by the order of their values, nulls first. A null delivery counts as
    the latest, null keys are never sampled, other columns are ignored, an empty table gives an empty sample.
    """
    row = F.struct(F.coalesce(F.col(delivery), F.lit(2**31 - 1)).alias("at"), *(F.col(f) for f in fields))
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("row"))
    placed = first.select(key, *(F.col(f"row.{f}").alias(f) for f in fields), unit(F.col(key), salt).alias("place"))
    return placed.filter(F.col("place") < rate)


def speech_sample(meta: DataFrame) -> DataFrame:
    """The stratified sample of speeches: a fifth of those with the seed vocabulary, a tenth of the rest."""
    rate = F.when(F.col("seed_present"), RATES[True]).when(~F.col("seed_present"), RATES[False]).otherwise(RATE)
    return stable_sample(meta, "speech_id", "snapshot_no", ["era", "speech_type", "seed_present"], rate)


SQL = f"""
WITH f AS (
  SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY coalesce(snapshot_no, 2147483647), era NULLS FIRST, speech_type NULLS FIRST, seed_present NULLS FIRST) AS n
  FROM meta WHERE speech_id IS NOT NULL
), p AS (
  SELECT speech_id, era, speech_type, seed_present,
    ('0x' || substr(md5('{SALT}|' || speech_id), 1, {DIGITS}))::BIGINT / {float(16**DIGITS)!r} AS place
  FROM f WHERE n = 1
)
SELECT * FROM p WHERE place < CASE WHEN seed_present THEN {RATES[True]} ELSE {RATES[False]} END
"""
