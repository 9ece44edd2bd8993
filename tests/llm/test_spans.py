import random
import time

import numpy as np

from rostra.llm import spans


def share(a, b, n):
    have = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in have for i in range(len(b) - n + 1))


def make(rng, n):
    alphabet = ["word ", "fair, ", "X", "字", "12 ", "\n", "éa ", "longerthananythingelsehere ", "....", "ไทย", "😀"]
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_pairs_against_brute_force(spark, clash):
    rng = random.Random(7)
    texts = {}
    pool = [make(rng, 80)[: rng.choice([150, 199, 200, 201, 260])] for _ in range(12)] + ["q" * 230, "-" * 210, "z9" * 120]
    for i in range(90):
        body = make(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            body += rng.choice(pool) + make(rng, rng.randint(0, 10))
        texts[i] = body
    texts[200] = texts[201] = texts[202] = make(rng, 100)
    texts[203] = texts[204] = ""
    texts[205] = texts[200][:250] + "!"
    rows = [*texts.items(), (300, None), (None, texts[200]), (5, texts[5])]
    want = {(a, b) for a in texts for b in texts if a < b and share(texts[a], texts[b], 200)}
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in spans.found(df).collect()} == want and len(want) > 20
    assert spans.found(df.limit(0)).count() == 0
    held = {}
    for r in spans.classes(df, "doc_id", "text").collect():
        held.setdefault(r["class_id"], []).append((r["doc_id"], r["members"]))
    assert all(len(m) == n == len({k for k, _ in m}) for m in held.values() for _, n in m)
    assert {(a, b) for m in held.values() for a, _ in m for b, _ in m if a < b} == want
    parts = {r["doc_id"]: r for r in spans.shared_parts(df, "doc_id", "text").collect()}
    assert parts[200]["share"] == 1.0 and parts[203]["shared_chars"] == 0 and set(parts) == {*texts, 300}
    assert all(parts[a]["shared_chars"] <= parts[a]["n_chars"] for a in parts)


def test_large_classes_keep_every_link(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(spans, "MEMBERS", 16)
    same, other = make(rng, 120), make(rng, 120)
    # A hundred copies of one text, a partial sharer, and a header over texts that differ.
    rows = [(i, same) for i in range(100)] + [(100, other + same[:300])] + [(200 + i, same[100:400] + make(rng, 40)) for i in range(60)]
    texts = dict(rows)
    want = {(a, b) for a in texts for b in texts if a < b and share(texts[a], texts[b], 200)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (spans.SMALL, 0):
        monkeypatch.setattr(spans, "SMALL", bound)
        assert {tuple(r) for r in spans.found(df).collect()} == want and len(want) > 12_000
    assert spans.classes(df, "doc_id", "text").count() < 10 * len(rows)


def test_a_common_header_is_fast(spark):
    rng = random.Random(3)
    head = make(rng, 200)[:300]
    df = spark.createDataFrame([(i, head + make(rng, 30)) for i in range(2000)], "doc_id long, text string")
    began = time.time()
    assert spans.found(df).count() == 2000 * 1999 // 2 and time.time() - began < 60


def test_parts_of_long_texts_overlap(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(spans, "BLOCK", 1000)
    text = make(rng, 3000)
    for size in (1, 700, 1000, 1001, 1799, 1800, 4000):
        seen = {p + o for n, offs, parts in spans._parts([text[:size]]) for o, part in zip(offs, parts) for p in range(len(part) - 199)}
        assert seen == set(range(size - 199 if size >= 200 else 0))
    piece = text[900:1130]
    owner, place, _ = spans.anchors([text[:1000]], spans.Roll(1000))
    assert len(owner) and place.max() + spans.WINDOW <= 1000
    assert len(piece) == 230


def test_hashes_depend_on_the_window_alone():
    rng = random.Random(9)
    core, roll = make(rng, 90)[:400], spans.Roll(1 << 16)
    texts = ["abc " + core, "other words before it " + core, "", "tail " + core[100:310]]
    owner, place, hashes = spans.anchors(texts, roll)
    seen = {}
    for o, p, h in zip(owner, place, hashes):
        window = texts[o][p : p + spans.WINDOW]
        assert len(window) == spans.WINDOW and seen.setdefault(window, h) == h
    assert len(set(map(int, hashes))) == len(seen) and isinstance(hashes, np.ndarray)
    # Whatever stands around them, the shared characters keep an anchor in common, within a stretch of their start.
    for size in (200, 201, 230):
        for at in (0, 57, 133):
            piece = core[at : at + size]
            sides = [make(rng, 20) + piece + make(rng, 20), "" + piece, make(rng, 3) + piece]
            owner, place, hashes = spans.anchors(sides, roll)
            common = set.intersection(*({int(h) for o, h in zip(owner, hashes) if o == i} for i in range(3)))
            assert common


def test_shared_parts_against_brute_force(spark):
    rng = random.Random(11)
    pool = [make(rng, 120)[:n] for n in range(196, 216)]
    # Two parts of 160 characters, each with another partner: together above 200, but no partner shares 200.
    one, two = make(rng, 80)[:160], make(rng, 80)[:160]
    texts = {0: make(rng, 20) + one + two + make(rng, 20), 1: "A" + one + "b", 2: "C" + two + "d" + make(rng, 9)}
    for i in range(3, 60):
        texts[i] = "".join(make(rng, rng.randint(0, 12)) + "x" * rng.randint(0, 3) + rng.choice(pool) + "y" * rng.randint(0, 3) for _ in range(rng.randint(1, 3)))
    texts[60] = texts[61] = make(rng, 90)
    texts |= {62: "k" * 430, 63: "m" + "k" * 350, 64: "", 65: pool[5] + pool[6] + pool[9], 66: texts[60][:300]}
    want = {}
    for a, x in texts.items():
        have = {y[i : i + 200] for b, y in texts.items() if b != a for i in range(len(y) - 199)}
        in_span = {p for i in range(len(x) - 199) if x[i : i + 200] in have for p in range(i, i + 200)}
        want[a] = (sum(p - 1 not in in_span for p in in_span), len(in_span))
    df = spark.createDataFrame([*texts.items(), (5, texts[5]), (70, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["shared_chars"]) for r in spans.shared_parts(df, "doc_id", "text").collect()}
    assert got == want | {70: (0, 0)} and sum(n > 0 for n, _ in want.values()) > 40
