import random

from pyspark.sql import functions as F

from rostra.operators.intervals import party_periods, periods_and_gaps


def brute(rows):
    covered = {}
    for e, a, b in rows:
        if a is not None and b is not None and a <= b:
            covered.setdefault(e, set()).update(range(a, b + 1))
    out = set()
    for e, years in covered.items():
        years = sorted(years)
        start = years[0]
        for x, y in zip(years, [*years[1:], None]):
            if y != x + 1:
                out.add((e, "period", start, x))
                if y is not None:
                    out.add((e, "gap", x + 1, y - 1))
                start = y
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a = rng.randint(1790, 2025)
        rows.append((rng.choice(["x", "y", "z", None, "hot", "hot", "hot"]), a, a + rng.choice([-1, 0, 0, 1, 3, 70, 200])))
    rows += [("x", None, 3), ("x", 4, None)] + rows[:50]
    df = spark.createDataFrame(rows, "e string, s int, t int").withColumns({c: F.lit(0) for c in ("a", "b", "kind", "run", "shard", "entity_0")})
    for shard in (4, 32):
        got = periods_and_gaps(df, ["e"], "s", "t", shard)
        assert {tuple(r) for r in got.collect()} == brute(rows)
        assert got.columns == ["e", "kind", "from_year", "to_year"]


def test_huge_interval_stays_small(spark):
    df = spark.createDataFrame([("x", -(2**30), 2**30), ("x", 5, 6)], "e string, s int, t int")
    assert [tuple(r) for r in periods_and_gaps(df, ["e"], "s", "t").collect()] == [("x", "period", -(2**30), 2**30)]


def test_party_rules(spark):
    ddl = "speaker_name string, party string, start_year int, end_year int, kind string"
    rows = [
        ("s", " Whig ", 1900, 1902, "?"), ("s", "WHIG", 1903, 1904, "?"), ("s", "whig", 1910, None, "?"), ("s", " ", 1900, 1950, "?"), ("s", None, 1900, 1950, "?"),
        ("s", "tory", None, 1950, "?"), ("s", "tory", 1950, 1949, "?"), (None, "tory", 1950, 1950, "?"),
    ]
    got = {tuple(r) for r in party_periods(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {("s", "whig", "period", 1900, 1904), ("s", "whig", "gap", 1905, 1909), ("s", "whig", "period", 1910, 2025), (None, "tory", "period", 1950, 1950)}
    assert party_periods(spark.createDataFrame([], ddl)).count() == 0
