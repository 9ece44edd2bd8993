"""Long spans that stand verbatim in more than one record, by Rabin-Karp hashes of fixed-length windows of tokens.

A token is a character, as in the byte-level scheme of the project, so that "at least ``LEAST``, exactly as written" is a
window of ``LEAST`` tokens that two records share. Hashes of every such window would outweigh the corpus; so a first pass
hashes the window behind every *anchor*. An anchor has the least hash of ``GRAM`` characters within some stretch of
``STRETCH`` neighbours, so any ``LEAST`` characters that two records share hold a common anchor and the whole window
behind it: what has no repeated anchor window is in no shared span, and what has one is hashed at every place. Spark
counts both kinds of windows with partial aggregates. Repeated windows merge into maximal intervals; the set of records of
a window is its class. Hashes of the second pass have 96 bits over randomised characters and are taken for the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.runtime import checkpointed, map_rows, sized, struct

LEAST, GRAM, STRETCH = 200, 8, 80
WINDOW = LEAST - STRETCH + 1
#: Rows up to which repeated windows, the texts of candidates, and windows of classes are picked by a broadcast, some MB; by a shuffle beyond.
SMALL = 500_000
#: Characters whose hashes are worked out at a time; longer texts go through in parts that overlap by a window.
BLOCK = 1 << 20
#: Members of a class that are paired with each other in one task.
MEMBERS = 1024

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roll:
    """Rabin-Karp hashes modulo 2 ** 64 over texts of at most a block; built once for a task."""

    def __init__(self, block: int):
        # A random number for each code point, so that no two texts collide for how their characters are numbered.
        self.letters = _mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.powers = [[self._powers(b, block) for b in (base, pow(base, -1, 1 << 64))] for base in _BASES]

    @staticmethod
    def _powers(base: int, block: int) -> np.ndarray:
        line = np.full(block + 1, base, dtype=np.uint64)
        line[0] = 1
        return np.multiply.accumulate(line)

    def sums(self, codes: np.ndarray, base: int) -> np.ndarray:
        """Running sums of the characters, each times its power of a base."""
        out = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(self.letters[codes] * self.powers[base][0][: len(codes)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, base: int, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` at some places: a sum that is rolled on by two look-ups."""
        return _mixed((sums[at + size] - sums[at]) * self.powers[base][1][at])


def _extreme(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """Least or greatest value of every ``size`` neighbours, by windows that double."""
    out, width = x, 1
    while width * 2 <= size:
        out = of(out[:-width], out[width:])
        width *= 2
    return of(out[: len(x) - size + 1], out[size - width : size - width + len(x) - size + 1]) if width < size else out


def anchors(parts: list[str], roll: Roll) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows behind the anchors of some texts of at most a block in all: (number of the text, start in it, hash)."""
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    none = np.empty(0, dtype=np.int64)
    if n < LEAST:
        return none, none, none.astype(np.uint64)
    sums = roll.sums(codes, 0)
    grams = np.full(n, _LAST)
    grams[: n - GRAM + 1] = roll.hashes(sums, 0, np.arange(n - GRAM + 1), GRAM)
    ends = np.cumsum(lengths)
    # What runs over the end of a text is no gram of it.
    for back in range(1, GRAM):
        grams[np.maximum(ends - back, 0)] = _LAST
    least = _extreme(grams, STRETCH, np.minimum)
    low = np.zeros(n + STRETCH - 1, dtype=np.uint64)
    low[STRETCH - 1 : STRETCH - 1 + len(least)] = least
    at = np.flatnonzero((grams == _extreme(low, STRETCH, np.maximum)) & (grams != _LAST))
    owner = np.searchsorted(ends, at, side="right")
    fits = ends[owner] - at >= WINDOW
    at, owner = at[fits], owner[fits]
    return owner, at - (ends - lengths)[owner], roll.hashes(sums, 0, at, WINDOW)


def _parts(texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Texts in blocks, as numbers, offsets and parts; parts of a long text overlap by a window."""
    numbers, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LEAST + 1), BLOCK - LEAST + 1):
            part = t[at : at + BLOCK] if len(t) > BLOCK else t
            if len(part) < LEAST:
                continue
            if size + len(part) > BLOCK:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, offsets, parts


def windows(texts: DataFrame) -> DataFrame:
    """Anchor windows of texts (k, t): (h, k, a, b), neighbours of one hash as one row from place a to b."""
    schema = struct("h long, k long, a int, b int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roll(BLOCK)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for numbers, offsets, parts in _parts(batch.column(1).to_pylist()):
                owner, place, hashes = anchors(parts, roll)
                if not len(owner):
                    continue
                opens = np.ones(len(owner), dtype=bool)
                opens[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(opens)
                place = place + np.asarray(offsets)[owner]
                last = place[np.append(first[1:], len(owner)) - 1]
                cols = (hashes[first].view(np.int64), keys[np.asarray(numbers)[owner[first]]].astype(np.int64), place[first].astype(np.int32), last.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=schema.names)

    return texts.select("k", "t").mapInArrow(run, schema)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k is not null").filter(F.length("t") >= LEAST)


def copies(texts: DataFrame) -> DataFrame:
    """Keys that have one text each, and the same: (k, rep), rep the least of them. Their windows are worked out once."""
    digest = F.struct(F.xxhash64("t").alias("x"), F.unhex(F.md5("t")).alias("m"))
    one = texts.select("k", digest.alias("d")).groupBy("k").agg(F.min("d").alias("d"), F.max("d").alias("e")).filter("d = e").select("k", "d")
    reps = one.groupBy("d").agg(F.min("k").alias("rep"), F.max("k").alias("top")).filter("rep < top").select("d", "rep")
    return one.join(reps, "d").select("k", "rep")


def _every(rows: Iterator[tuple], roll: Roll, places: bool) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows of ``LEAST`` in the marked regions of each record's texts: (h, g, k, many, s)."""
    for k, many, texts, spans in rows:
        spans = np.array([(s["a"], s["b"]) for s in spans])
        found = []
        for _, offsets, parts in _parts(texts):
            for offset, part in zip(offsets, parts):
                codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if not (room := len(codes) - LEAST + 1) > 0:
                    continue
                marked = np.zeros(len(codes) + 1, dtype=np.int32)
                a, b = np.clip(spans[:, 0] - STRETCH + 1 - offset, 0, room), np.clip(spans[:, 1] + 1 - offset, 0, room)
                np.add.at(marked, a, 1)
                np.add.at(marked, b, -1)
                at = np.flatnonzero(np.cumsum(marked)[:room] > 0)
                h, g = (roll.hashes(roll.sums(codes, base), base, at, LEAST) for base in (0, 1))
                found.append((h.view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32), at + offset))
        if not found:
            continue
        h, g, s = (np.concatenate(x) for x in zip(*found))
        if not places:
            _, once = np.unique(h, return_index=True)
            h, g, s = h[once], g[once], s[once]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(np.full(len(h), k)), pa.array(np.full(len(h), many)), pa.array(s.astype(np.int32))], names=["h", "g", "k", "many", "s"])


def repeated(texts: DataFrame, same: DataFrame, places: bool) -> DataFrame:
    """Windows of ``LEAST`` in what may be shared: (h, g, k, many, s); ``many``: other records have this text as a whole."""
    found = windows(texts)
    twice = checkpointed(found.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("h"))
    marks = checkpointed(windows(texts).join(sized(twice, SMALL), "h").groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    regions = checkpointed(marks.join(same, "k", "left").filter("rep is null or rep = k").select("k", "spans", F.col("rep").isNotNull().alias("many")))
    # Only the texts of candidates are moved.
    bodies = texts.join(sized(regions.select("k"), SMALL), "k", "left_semi").groupBy("k").agg(F.collect_set("t").alias("texts"))
    rows = bodies.join(regions, "k").select("k", "many", "texts", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roll(BLOCK)
        for batch in batches:
            yield from _every(zip(*(c.to_pylist() for c in batch.columns)), roll, places)

    return rows.mapInArrow(run, struct("h long, g int, k long, many boolean, s int"))


def shared_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Classes of records that share ``LEAST`` characters in a row: (h, g, k), a row for each member of a class.

    A class is the set of records that hold some window, told by the hash (h, g) of one of its windows; each set comes once.
    Any two members share a span, and any two records that share one are in some class together, so the classes are all
    links in the size of their memberships, however many records hold a span. Records with equal texts are members alike.
    """
    texts = _texts(df, key, text)
    same = checkpointed(copies(texts))
    rows = repeated(texts, same, False)
    sets = rows.groupBy("h", "g").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y"), F.bool_or("many").alias("many")
    ).filter("n > 1 or many")
    first = checkpointed(sets.groupBy("n", "x", "y").agg(F.min(F.struct("h", "g")).alias("w")).select("w.h", "w.g"))
    held = rows.join(sized(first, SMALL), ["h", "g"]).select("h", "g", F.col("k").alias("rep"))
    return held.join(same, "rep", "left").select("h", "g", F.coalesce("k", "rep").alias("k"))


def shared_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of records whose texts have at least ``LEAST`` characters in a row in common: (a, b), a < b, all of them.

    The pairs of a class are written by blocks of its members, so that no class is one task; where classes are too large
    for pairs, `shared_classes` says the same. Null keys and texts, and texts below ``LEAST``, are in no pair; repeated rows
    change nothing; texts under one key count together; other columns are ignored; an empty table gives an empty one.
    """
    members = checkpointed(shared_classes(df, key, text))
    sizes = members.groupBy("h", "g").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    placed = members.join(sizes, ["h", "g"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    left = placed.select("h", "g", F.col("k").alias("a"), F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"))
    right = placed.select("h", "g", F.col("k").alias("b"), F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high"))
    pairs = left.join(right, ["h", "g", "low", "high"]).filter("low < high or a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def found(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of documents that share a long span."""
    return shared_pairs(docs, "doc_id", "text").withColumnsRenamed({"a": "doc_id_a", "b": "doc_id_b"})


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Membership in shared spans: (class_id, ``key``, members), a row for each record of each class of `shared_classes`."""
    members = checkpointed(shared_classes(df, key, text))
    sizes = members.groupBy("h", "g").agg(F.count("*").alias("members"))
    return members.join(sizes, ["h", "g"]).select(F.format_string("%016x%08x", "h", "g").alias("class_id"), F.col("k").alias(key), "members")


def _runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    for k, starts in rows:
        s = np.unique(np.asarray(starts, dtype=np.int64))
        cuts = np.flatnonzero(np.diff(s) > LEAST)
        first, last = s[np.append(0, cuts + 1)], s[np.append(cuts, len(s) - 1)]
        yield (k, len(first), int((last + LEAST - first).sum()))


def shared_parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """How much of each record stands elsewhere: (``key``, n_chars, spans, shared_chars, share), a row for every key.

    Repeated windows of ``LEAST`` characters that overlap or adjoin merge into maximal intervals, so shared_chars counts the
    characters that lie in some span of ``LEAST`` which some other record has too. Nulls count as empty texts.
    """
    texts = _texts(df, key, text)
    same = checkpointed(copies(texts))
    rows = repeated(texts, same, True)
    twice = rows.groupBy("h", "g").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.bool_or("many").alias("many")).filter("lo < hi or many").select("h", "g")
    starts = rows.join(twice, ["h", "g"]).groupBy("k").agg(F.collect_list("s").alias("starts"))
    runs = map_rows(starts, _runs, "rep long, spans int, shared_chars long")
    sums = runs.join(same, "rep", "left").select(F.coalesce("k", "rep").alias("k"), "spans", "shared_chars")
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).filter("k is not null")
    rows = rows.groupBy("k").agg(F.max("n_chars").alias("n_chars"))
    out = rows.join(sums, "k", "left").select(
        F.col("k").alias(key), "n_chars", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars")
    )
    return out.withColumn("share", F.round(F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0), 4))
