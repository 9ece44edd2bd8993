"""Binning of years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-open bins of years for sampling and, on purpose different, for analysis.
SAMPLING_ERAS = (("pre_1900", 1803, 1900), ("1900_1945", 1900, 1945), ("1945_1980", 1945, 1980), ("1980_2005", 1980, 2005), ("2005_2025", 2005, 2026))
ANALYSIS_ERAS = (("pre-1900", 0, 1900), ("1900-1947", 1900, 1948), ("post-1948", 1948, 2101))


def era_of(year: Column, eras: tuple = ANALYSIS_ERAS) -> Column:
    """Name of the bin that holds the year; null outside the bins and for what is no number."""
    number = year.try_cast("double")
    out = F.lit(None).cast("string")
    for name, low, high in reversed(eras):
        out = F.when((number >= low) & (number < high), name).otherwise(out)
    return out


def decade_of(year: Column) -> Column:
    """First year of the decade."""
    return (F.floor(year / 10) * 10).cast("int")


def era_rank(era: Column, eras: tuple = ANALYSIS_ERAS) -> Column:
    """Place of a bin in time, as a sort key."""
    return F.array_position(F.lit([name for name, _, _ in eras]), era)


def era_sql(year: str, eras: tuple) -> str:
    """The bins as an SQL expression."""
    return "CASE " + " ".join(f"WHEN {year} >= {a} AND {year} < {b} THEN '{n}'" for n, a, b in eras) + " END"
