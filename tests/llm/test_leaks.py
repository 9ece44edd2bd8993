import random

from rostra.llm import leaks


def brute_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places."""
    marked_d, marked_i, tiles = set(), set(), []
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in marked_d and j + n not in marked_i:
                    n += 1
                if n >= least:
                    best.append((n, i, j))
        if not best:
            return sorted(tiles)
        longest = max(best)[0]
        for n, i, j in sorted(best, key=lambda x: (x[1], x[2])):
            if n == longest and not marked_d & set(range(i, i + n)) and not marked_i & set(range(j, j + n)):
                marked_d |= set(range(i, i + n))
                marked_i |= set(range(j, j + n))
                tiles.append((i, j, n))


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.choice("abcdef") for _ in range(rng.randint(0, 14))]
        doc = [rng.choice("abcdef") for _ in range(rng.randint(0, 25))]
        if item and rng.random() < 0.6:
            doc[3:3] = item[len(item) // 2 :] + ["z"] + item[: len(item) // 2]
        assert sorted(leaks.tile(doc, item, 3)) == brute_tiles(doc, item, 3)


def test_leaks(spark, clash):
    words = [f"w{i}" for i in range(24)]
    item = " ".join(words)
    moved = " ".join(words[12:18] + ["filler"] + words[6:12] + ["filler"] + words[0:6])
    rows = [
        (1, "Start " + " , ".join(words[3:15]).upper() + " end"), (2, " ".join(words[3:14])), (3, None), (4, ""), (5, moved), (None, item), (6, ("pad " * 50_000) + item), (1, "Start " + " , ".join(words[3:15]).upper() + " end"),
    ]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    items = clash(spark.createDataFrame([(10, item), (11, item), (12, None), (13, "too short"), (10, item)], "item_id long, text string"))
    assert {tuple(r) for r in leaks.found(docs, items).collect()} == {(d, i) for d in (1, None, 6) for i in (10, 11)}
    moved_rows = leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").filter("doc_id = 5 and item_id = 10").collect()
    assert [(r["longest"], r["covered"]) for r in moved_rows] == [(6, 18)]
    assert leaks.found(docs.limit(0), items).count() == 0 and leaks.found(docs, items.limit(0)).count() == 0


def test_repetitive_texts_are_tiled_in_little_time():
    import time

    rng = random.Random(2)
    doc, item = [rng.choice("ab") for _ in range(2400)], [rng.choice("ab") for _ in range(240)]
    began = time.time()
    tiles = leaks.tile(doc, item)
    assert sum(n for _, _, n in tiles) > 200 and time.time() - began < 2
    assert all(doc[i : i + n] == item[j : j + n] for i, j, n in tiles)


def test_seeds_by_shuffle_and_runs_by_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = {i: [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] for i in range(40)}
    passages = {100 + i: [rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for i in range(9)}
    for i in range(0, 40, 2):
        p = passages[rng.choice(list(passages))]
        at, n = rng.randint(0, max(0, len(p) - 13)), rng.choice([11, 12, 13, 30])
        texts[i] += p[at : at + n] + ["w1", *texts[i][:4]]
    runs = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {(d, i) for d, x in texts.items() for i, y in passages.items() if runs(x) & runs(y)}
    best = lambda x, y: max((n for i in range(len(x)) for j in range(len(y)) for n in (next((m for m in range(len(x)) if i + m >= len(x) or j + m >= len(y) or x[i + m] != y[j + m]), 0),)), default=0)
    docs = spark.createDataFrame([(k, ", ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in passages.items()], "item_id long, text string")
    for bound in (500_000, 0):
        monkeypatch.setattr(leaks, "SEEDS", bound)
        rows = leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows if r["longest"] >= 12} == want and len(want) > 5
        assert all(r["longest"] == best(texts[r["doc_id"]], passages[r["item_id"]]) for r in rows)
