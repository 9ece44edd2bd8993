import random

import regex

from rostra.llm import splitting as S

RUN = r"[^\s\p{Z}\p{P}\p{S}]"


def texts(rng, n):
    for _ in range(n):
        dense = rng.choice([0.03, 0.2, 0.6])
        yield "".join(rng.choice("ab. ,\n字「") if rng.random() < dense else "x" for _ in range(rng.randint(0, 400)))


def test_pieces_against_brute_force():
    rng = random.Random(2)
    for t in texts(rng, 600):
        p = list(S.pieces(t, 0, len(t), 20, 5))
        assert p[0][0] == 0 and p[-1][1] == len(t) and all(e - s <= 20 for s, e, _ in p)
        assert all(b[0] <= a[1] < b[1] for a, b in zip(p, p[1:]))
        assert (len(p) > 1) == (len(t) > 20)
        assert any(f for *_, f in p) == bool(regex.search(RUN + "{21}", t))


def test_ranges_cover_and_number(spark, clash):
    rng = random.Random(4)
    long = "".join(rng.choice(["word ", "another. ", "x\n"]) for _ in range(3000))
    rows = [(1, long), (1, long), (2, None), (3, ""), (4, "short"), (None, "y" * 90), (5, "z" * 700)]
    df = clash(spark.createDataFrame(rows, "doc long, body string"))
    cut = S.split_texts(df, "doc", "body", 40, 8, size=1000)
    assert [(r["start_char"], r["end_char"]) for r in cut.filter("doc = 3").collect()] == [(0, 0)] and cut.filter("doc = 2").count() == 0
    pieces = cut.collect()
    by = {}
    for r in pieces:
        by.setdefault((r["doc"], r["uid"]), []).append(r)
    assert len(by) == 6
    for (doc, _), own in by.items():
        own.sort(key=lambda r: r["piece"])
        t = {1: long, 3: "", 4: "short", None: "y" * 90, 5: "z" * 700}[doc]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert own[0]["start_char"] == 0 and own[-1]["end_char"] == len(t) and all(r["end_char"] - r["start_char"] <= 40 for r in own)
        assert all(b["start_char"] <= a["end_char"] < b["end_char"] for a, b in zip(own, own[1:]))
        if doc == 1:
            assert not any(r["forced"] for r in own)
            shared = [a["end_char"] - b["start_char"] for a, b in zip(own, own[1:])]
            assert 3 <= sum(shared) / len(shared) <= 9
    got = {tuple(r) for r in S.oversized(df, "doc", "body", 40, 8).collect()}
    assert got == {(1, "oversized"), (None, "oversized"), (5, "oversized"), (None, "no_boundary"), (5, "no_boundary")}
    assert S.split_texts(df.limit(0), "doc", "body").count() == 0


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(6)
    text = "".join(rng.choice(["wörd ", "字。", "plain text, ", "line\n"]) for _ in range(4000))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("")
    raw = text.encode()
    got = S.split_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], 50, 10, size=3000).collect()
    own = sorted((r["piece"], r["start_byte"], r["end_byte"]) for r in got if r["path"].endswith("a.txt"))
    assert own[0][1] == 0 and own[-1][2] == len(raw) and [x[0] for x in own] == list(range(len(own)))
    assert all(len(raw[s:e].decode()) <= 50 for _, s, e in own)
    assert all(b[1] <= a[2] < b[2] for a, b in zip(own, own[1:]))
    named = S.split_files(spark, [(tmp_path / "a.txt").as_uri()], 50, 10, size=3000).collect()
    assert sorted((r["piece"], r["start_byte"], r["end_byte"]) for r in named) == own


def test_overlap_without_spaces_and_at_range_bounds(spark, tmp_path):
    rng = random.Random(8)
    chars = [chr(c) for c in range(0x4E00, 0x4F00)]
    wide = "".join("".join(rng.choices(chars, k=rng.choice([4, 9, 30, 70]))) + rng.choice("，。；") for _ in range(400))
    spaced = "".join(rng.choice(["word ", "another. ", "x\n"]) for _ in range(3000))
    bare = "".join(rng.choices(chars, k=395)) + "。" + "".join(rng.choices(chars, k=3000))
    for text in (wide, spaced, bare, "。".join("".join(rng.choices(chars, k=190)) for _ in range(30)), " ".join("".join(rng.choices(chars, k=99)) for _ in range(60))):
        own = list(S.pieces(text, 0, len(text), 400, 80))
        assert all(40 <= a[1] - b[0] <= 120 for a, b in zip(own, own[1:]))
    df = spark.createDataFrame([(1, wide), (2, spaced)], "doc long, body string")
    for doc in (1, 2):
        rows = sorted(S.split_texts(df.filter(f"doc = {doc}"), "doc", "body", size=2000).collect(), key=lambda r: r["piece"])
        assert S.split_ranges(df.filter(f"doc = {doc}"), "doc", "body", size=2000).count() > 4 and all(40 <= a["end_char"] - b["start_char"] <= 120 for a, b in zip(rows, rows[1:]))
        assert all(r["end_char"] - r["start_char"] <= 400 for r in rows)
    (tmp_path / "c.txt").write_text(wide)
    raw = wide.encode()
    rows = sorted(tuple(r)[1:4] for r in S.split_files(spark, [str(tmp_path / "c.txt")], size=6000).collect())
    assert len(rows) > 20 and all(40 <= len(raw[b[1] : a[2]].decode()) <= 120 for a, b in zip(rows, rows[1:]))


def test_slices_give_what_the_whole_text_gives(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice(["word ", "another. ", "x\n", "字", "y" * 60]) for _ in range(n))) for i, n in enumerate((0, 3, 900, 4000))]
    df = spark.createDataFrame(rows, "doc long, body string")
    one = sorted(map(tuple, S.split_texts(df, "doc", "body", size=500).drop("uid").collect()))
    monkeypatch.setattr(S, "NEAR", 1)
    assert sorted(map(tuple, S.split_texts(df, "doc", "body", size=500).drop("uid").collect())) == one
