"""Evaluation passages in a corpus, by greedy string tiling over words.

Documents and items meet in Spark on the rolling hashes of their seeds; a pair whose seeds cannot make a leak is dropped by
counts alone. What is left is tiled: the longest match that neither side has used is marked, again and again, its length
found by Karp and Rabin's running hashes. Tiles need the seeds only, so no text is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rostra.runtime import map_rows, sized, struct

#: Words of a seed, the shortest match that is tiled.
SEED = 4
#: Words in a row that make a leak, and share of an item's words that makes one when its passages are moved about.
RUN, COVER = 12, 0.6
#: Seeds of the items up to which they are sent to the documents; beyond, both sides are shuffled.
SEEDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15


def words(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case."""
    return _WORD.findall(text.casefold())


class Roll:
    """Running hashes of the windows of a sequence of whole numbers, modulo 2 ** 64."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        up = np.full(n + 1, _BASE, dtype=np.uint64)
        down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_spread(numbers) * np.multiply.accumulate(up)[:n], out=self.sums[1:])

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` that start at some places."""
        return _spread((self.sums[at + size] - self.sums[at]) * self.down[at])


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _number(word: str) -> int:
    """A number of a word that is the same in every process."""
    out = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        out = (out ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return out


def _free(used: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of ``size`` that hold nothing used."""
    taken = np.concatenate(([0], np.cumsum(used)))
    return np.flatnonzero(taken[size:] == taken[:-size]) if len(used) >= size else np.empty(0, dtype=np.int64)


def tile(doc: list, item: list, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiles (doc start, item start, length): the longest matches first, none overlapping another.

    In each round the greatest length at which free windows of both sides have a hash in common is found by halving, as a
    match of a length holds one of each lesser length; the matches of that length are marked in the order of the document.
    Equal hashes are compared word by word.
    """
    numbers = {w: i for i, w in enumerate(dict.fromkeys([*item, *doc]))}
    x, y = (np.fromiter((numbers[w] for w in side), dtype=np.uint64, count=len(side)) for side in (doc, item))
    rolls, used = (Roll(x), Roll(y)), (np.zeros(len(x), dtype=bool), np.zeros(len(y), dtype=bool))

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, to = _free(used[0], size), _free(used[1], size)
        h, g = rolls[0].windows(at, size), rolls[1].windows(to, size)
        met = np.isin(h, g)
        return at[met], h[met], to, g

    tiles, most = [], min(len(x), len(y))
    while most >= seed and len(common(seed)[0]):
        low, high = seed, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        at, h, to, g = common(low)
        places: dict[int, list[int]] = {}
        for j, v in zip(to.tolist(), g.tolist()):
            places.setdefault(v, []).append(j)
        marked = False
        for i, v in zip(at.tolist(), h.tolist()):
            if used[0][i] or used[0][i + low - 1]:
                continue
            j = next((j for j in places[v] if not used[1][j] and not used[1][j + low - 1] and (x[i : i + low] == y[j : j + low]).all()), -1)
            if j >= 0:
                used[0][i : i + low] = used[1][j : j + low] = True
                tiles.append((i, j, low))
                marked = True
        # Hashes that only seem to be equal must not go round for ever.
        most = low if marked else low - 1
    return tiles


def _seeds(rows: DataFrame, size: int) -> DataFrame:
    """Seeds of texts (k, t): (h, k, i), the rolling hash of the ``size`` words from the i-th on, and their number n."""
    schema = StructType([StructField("h", struct("h long")["h"].dataType), rows.schema["k"], *struct("i int, n int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            own, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(texts):
                numbers, ends, first = [], [], at
                while at < len(texts) and (not ends or ends[-1] < 200_000):
                    for w in words(texts[at]):
                        if (n := known.get(w)) is None:
                            if len(known) > 500_000:
                                known.clear()
                            n = known[w] = _number(w)
                        numbers.append(n)
                    ends.append(len(numbers))
                    at += 1
                if len(numbers) < size:
                    continue
                ends = np.array(ends)
                counts = np.diff(ends, prepend=0)
                starts = np.arange(len(numbers) - size + 1)
                owner = np.searchsorted(ends, starts, side="right")
                fits = starts + size <= ends[owner]
                starts, owner = starts[fits], owner[fits]
                if len(starts):
                    h = Roll(np.array(numbers, dtype=np.uint64)).windows(starts, size).view(np.int64)
                    cols = [pa.array(h), own.take(pa.array(owner + first)), pa.array((starts - (ends - counts)[owner]).astype(np.int32)), pa.array(counts[owner].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.select("k", "t").mapInArrow(run, schema)


def _tiled(run: int, cover: float, seed: int):
    def tiled(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, item, n, hits in rows:
            # The words of an item that seeds show, by number: those of equal seeds are equal. What no seed shows matches nothing.
            hits = sorted((x["i"], x["j"]) for x in hits)
            ours, theirs = {}, {}
            alike = list(range(n))

            def root(j: int) -> int:
                while alike[j] != j:
                    alike[j] = alike[alike[j]]
                    j = alike[j]
                return j

            for i, j in hits:
                for d in range(seed):
                    if i + d in ours:
                        alike[root(j + d)] = root(ours[i + d])
                    ours[i + d] = theirs[j + d] = j + d
            # Breaks in what the seeds cover stay breaks.
            doc, last = [], None
            for i in sorted(ours):
                if last is not None and i > last + 1:
                    doc.append(-1)
                doc.append(root(ours[i]))
                last = i
            tiles = tile(doc, [root(j) if j in theirs else -2 - j for j in range(n)], seed)
            longest, covered = max((x[2] for x in tiles), default=0), sum(x[2] for x in tiles)
            if longest >= run or covered >= cover * n:
                yield (k, item, longest, covered, n)

    return tiled


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN, cover: float = COVER) -> DataFrame:
    """Documents and the items that they contain: (``key``, ``item_key``, longest, covered, n_words).

    Either ``run`` words in a row are shared, or tiles cover the share ``cover`` of the item. Null and empty texts contain
    nothing, repeated rows are reported once, of several texts under one key each is judged by itself, items with one text
    are all reported, other columns are ignored.
    """
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).filter("t is not null")
    texts = held.select(F.struct("key", F.xxhash64("t").alias("d")).alias("k"), "t")
    parts = items.select(F.struct(F.col(item_key).alias("key"), F.xxhash64(item_text).alias("d")).alias("k"), F.col(item_text).alias("t")).filter("t is not null").distinct()
    # Passages below a seed cannot be told apart; the seeds of the items are the small side.
    known = _seeds(parts, SEED).select("h", F.col("k").alias("item"), F.col("i").alias("j"), "n")
    found = _seeds(texts, SEED).select("h", "k", "i").join(sized(known, SEEDS), "h")
    # Words of the item that seeds cover, and seeds in a row, are bounds of what tiles can reach.
    pairs = found.groupBy("k", "item", "n").agg(F.collect_set(F.struct("i", "j")).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["j"], x["j"] + SEED - 1)))))
    pairs = pairs.filter((covered >= F.lit(cover) * F.col("n")) | (covered >= run))
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((docs, key), (items, item_key)))
    flat = pairs.select(F.col("k.key").alias("k"), F.col("item.key").alias("item"), "n", "hits")
    out = map_rows(flat, _tiled(run, cover, SEED), f"k {kind}, item {item_kind}, longest int, covered int, n_words int").distinct()
    return out.withColumnsRenamed({"k": key, "item": item_key})


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents whose longest tile with an item has ``RUN`` words or more: (doc_id, item_id)."""
    return leaks(docs, "doc_id", "text", items, "item_id", "text").filter(F.col("longest") >= RUN).select("doc_id", "item_id").distinct()
