import random
from collections import Counter
from itertools import combinations

from rostra.llm import packing


def test_fullest_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        counts = Counter(items)
        got = packing.fullest(dict(counts), sorted(counts, reverse=True), room)
        best = max((sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room), default=0)
        assert sum(a * b for a, b in got) == best and all(b <= counts[a] for a, b in got)


def test_patterns_use_everything_once():
    rng = random.Random(2)
    histogram = Counter(rng.choice([rng.randint(1, 100), 50, 33]) for _ in range(5000))
    used, bins = Counter(), 0
    for pattern, repeat in packing.patterns(dict(histogram), 100):
        assert sum(a * b for a, b in pattern) <= 100 and repeat > 0
        bins += repeat
        for a, b in pattern:
            used[a] += b * repeat
    assert used == histogram and bins <= -(-sum(a * b for a, b in histogram.items()) // 100) * 1.02 + 1


def test_pack(spark, clash):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randint(0, 60)) for i in range(400)] + [(500 + i, "same length") for i in range(300)] + [(900, "字" * 100), (901, None), (None, "x"), (1, "again")]
    df = clash(spark.createDataFrame(rows, "doc long, body string"))
    got = packing.pack(df, "doc", "body", 128).collect()
    fill = Counter()
    for r in got:
        fill[r["bin"]] += r["size"]
    assert max(fill.values()) <= 128
    total = sum(len(t.encode()) for _, t in rows if t)
    assert sum(fill.values()) == total and len(fill) <= -(-total // 128) + 2
    big = sorted((r for r in got if r["doc"] == 900), key=lambda r: r["piece"])
    assert [(r["start_char"], r["end_char"]) for r in big] == [(0, 42), (42, 84), (84, 100)] and {r["pieces"] for r in got if r["doc"] != 900} == {1}
    assert len(got) == len(rows) - 1 + 2
    assert packing.pack(df.limit(0), "doc", "body").count() == 0
    assert {r[0] for r in packing.pack(df, "doc", "body", 128).filter("pieces > 1").select("doc").collect()} == {900}
