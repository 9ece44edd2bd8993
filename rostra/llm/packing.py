"""Packing of items into containers of fixed capacity by minimum bin slack.

Lengths are whole numbers up to the capacity, so a histogram of them says all there is to decide: each step takes the
longest length left, finds by a bitset subset-sum the fullest container that holds it, and repeats that pattern as often
as the histogram allows. The work depends on the number of distinct lengths only, however many items there are. Items are
then numbered within their length and take the places that the patterns left for it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostra.runtime import checkpointed, map_rows, small_rows

CAPACITY = 4096
#: Parts that the items of one length are numbered in.
PARTS = 256


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The multiset of available lengths with the greatest sum within ``room``: (length, times).

    Bit s of a set tells that sum s can be reached; lengths come longest first and the search ends at a full container.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            wider = reach | (reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + 1
            total -= length
    return sorted(taken.items(), reverse=True)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Container patterns ((length, times), ...) with their number of containers, until the histogram is used up."""
    counts = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        rest = fullest(counts, [x for x in lengths if counts[x]], capacity - first)
        counts[first] += 1
        pattern: dict[int, int] = {first: 1}
        for length, times in rest:
            pattern[length] = pattern.get(length, 0) + times
        repeat = min(counts[x] // t for x, t in pattern.items())
        yield sorted(pattern.items(), reverse=True), repeat
        for x, t in pattern.items():
            counts[x] -= t * repeat
        lengths = [x for x in lengths if counts[x]]


def places(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length, by the number of an item among its length: (first number, first container, items to a container)."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, repeat in patterns(histogram, capacity):
        for length, times in pattern:
            firsts, bins, each = out.setdefault(length, ([], [], []))
            firsts.append(used.get(length, 0))
            bins.append(base)
            each.append(times)
            used[length] = used.get(length, 0) + times * repeat
        base += repeat
    return out


def whole_pieces(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """Items to pack: (k, piece, pieces, start_char, end_char, size), the size in UTF-8 bytes, one token each.

    A text within the capacity is one piece. A larger one is cut into full pieces at whole characters and a rest.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").withColumn("size", F.octet_length("t"))
    small = rows.filter(F.col("size") <= capacity).select(
        "k", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start_char"), F.length("t").alias("end_char"), "size"
    )

    def cut(batch: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in batch:
            raw, at, chars, out = t.encode(), 0, 0, []
            while at < len(raw):
                end = min(at + capacity, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                n = len(raw[at:end].decode())
                out.append((chars, chars + n, end - at))
                at, chars = end, chars + n
            for i, (a, b, size) in enumerate(out):
                yield (k, i, len(out), a, b, size)

    kind = df.schema[key].dataType.simpleString()
    large = map_rows(rows.filter(F.col("size") > capacity).select("k", "t"), cut, f"k {kind}, piece int, pieces int, start_char int, end_char int, size int")
    return small.unionByName(large)


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """Containers of all texts: (``key``, piece, pieces, start_char, end_char, size, bin).

    Empty texts take no room and lie in container 0; null texts are left out. Rows that repeat a key are items of their
    own. Texts above the capacity are the only ones in more than one piece. Other columns are ignored; an empty table
    gives an empty one.
    """
    part = F.pmod(F.xxhash64("k", "piece", "start_char"), F.lit(PARTS)).cast("int")
    items = checkpointed(whole_pieces(df, key, text, capacity).withColumn("part", part))
    counted = items.filter("size > 0").groupBy("size", "part").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r["n"] for r in small_rows(counted.groupBy("size").agg(F.sum("n").alias("n")), capacity, "lengths")}
    table = places(histogram, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("size", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("size", "part").orderBy("k", "piece"))
    ranked = items.join(offsets, ["size", "part"], "left").withColumn("rank", F.coalesce("before", F.lit(0)) + number - 1)

    def assign(batch: Iterator[tuple]) -> Iterator[tuple]:
        for k, piece, pieces, a, b, size, rank in batch:
            if not size:
                yield (k, piece, pieces, a, b, size, 0)
                continue
            firsts, bins, each = table[size]
            i = bisect_right(firsts, rank) - 1
            yield (k, piece, pieces, a, b, size, bins[i] + (rank - firsts[i]) // each[i])

    kind = df.schema[key].dataType.simpleString()
    out = map_rows(ranked.select("k", "piece", "pieces", "start_char", "end_char", "size", "rank"), assign, f"k {kind}, piece int, pieces int, start_char int, end_char int, size int, bin long")
    return out.withColumnRenamed("k", key)


def split_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the texts that packing had to split."""
    return pack(df, key, text).filter("pieces > 1").select(key).distinct()
