"""Splitting of oversized texts at natural boundaries, range by range.

A text is cut into ranges with halos that workers handle by themselves. Both neighbours of a range bound derive the same
natural anchor from the halo around it; each range is split between its anchors, and the counts of pieces before a range,
summed over the boundary table, number the pieces. So a text of any length is never held or walked as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostra.runtime import map_rows, struct

LIMIT, OVERLAP = 400, 80
#: Code points of a range of a text, and bytes of a range of a file.
RANGE, FILE_RANGE = 1 << 16, 1 << 22
#: Ranges up to which a text is cut by the task that reads it, and tasks for the ranges of files at most.
NEAR, TASKS = 8, 10_000

# Where a cut may fall, best first; each pattern ends at the cut.
_CUTS = [re.compile(p) for p in (r"\n\s*\n\s*", r"\n\s*", r"[.!?…。！？।؟]+[\"'”’»)\]」』）]*(?:\s+|(?<=[。！？।」』]))", r"[;:,，、；：]\s*", r"\s+")]


def _loose(c: str) -> bool:
    """Is the character white space, punctuation or a symbol?"""
    return c.isspace() or unicodedata.category(c)[0] in "ZPS"


def _best(text: str, low: int, high: int) -> int:
    """The best natural cut in (low, high], as late as possible among the best; -1 if there is none."""
    half = low + (high - low) // 2
    for least in (half, low):
        for pattern in _CUTS:
            at = -1
            for m in pattern.finditer(text, least, high):
                if m.end() > least:
                    at = m.end()
            if at > least:
                return at
        for at in range(high, least, -1):
            if _loose(text[at - 1]) or at < len(text) and _loose(text[at]):
                return at
    return -1


def _first(text: str, low: int, high: int) -> int:
    """The first place in (low, high] beside a loose character; -1 if there is none."""
    return next((at for at in range(low + 1, high + 1) if _loose(text[at - 1]) or at < len(text) and _loose(text[at])), -1)


def _natural(text: str, at: int) -> bool:
    """May a piece start here: behind white space, punctuation or a symbol, or with an opening mark?"""
    here, before = unicodedata.category(text[at]), unicodedata.category(text[at - 1])
    if here in ("Ps", "Pi"):
        return True
    return _loose(text[at - 1]) and before not in ("Ps", "Pi") and not _loose(text[at])


def _back(text: str, cut: int, low: int, limit: int, overlap: int) -> int:
    """Where the piece after ``cut`` starts, at ``low`` or later: the natural place nearest to ``overlap`` before the cut.

    White space first, then other marks, behind that place before in front of it, each within half of the overlap; the
    place itself if there is neither. So no text, with or without spaces, loses more than half of the overlap.
    """
    back, half = max(cut - overlap, low), min(overlap, limit - overlap) // 2
    near = [*range(back, min(back + half, cut - 1) + 1), *range(back - 1, max(back - half, low) - 1, -1)]
    for at in near:
        if text[at - 1].isspace() and not text[at].isspace():
            return at
    return next((at for at in near if _natural(text, at)), min(back, cut))


def pieces(text: str, begin: int, end: int, limit: int, overlap: int, lead: bool = False) -> Iterator[tuple[int, int, bool]]:
    """Pieces (start, end, forced) that cover text[begin:end], each within ``limit``; forced: no natural cut was possible.

    ``lead``: the first piece shares the overlap with what stands before ``begin``.
    """
    start = reached = begin
    if lead and begin:
        start = _back(text, begin, 1, limit, overlap)
    while end - start > limit:
        low = max(reached, start + overlap)
        cut, forced = _best(text, low, start + limit) if low < start + limit else -1, False
        if cut <= reached and start < reached:  # the overlap leaves no room for a natural cut: as much of it as does
            after = _first(text, reached, min(reached + limit, end))
            if after < 0 and end - reached <= limit:
                after = end
            if after > 0:
                low = max(start, after - limit)
                start = next((at for at in range(max(low, 1), reached) if _natural(text, at)), low)
                if end - start <= limit:
                    break
                cut = _best(text, reached, start + limit)
        elif cut <= reached:
            cut = _best(text, reached, start + limit)
        if cut <= reached:
            cut, forced = start + limit, True
        yield (start, cut, forced)
        reached = cut
        # Back by the overlap to a natural place, but never to the start of this piece.
        start = _back(text, cut, start + 1, limit, overlap)
        if end - reached <= 0:
            return
    if reached < end or begin == end or reached == begin:
        yield (start, end, False)


def _anchor(text: str, base: int, at: int, halo: int, last: bool) -> tuple[int, bool]:
    """The cut that both ranges at a range bound derive from the same characters around it, and whether it is natural."""
    if last:
        return at, True
    low, high = max(at - halo, base) - base, min(at + halo, base + len(text)) - base
    cut = _best(text[low:high], 0, high - low)
    return (base + low + cut, True) if cut > 0 else (at, False)


def _cut(base: int, text: str, no: int, total: int, limit: int, overlap: int, size: int) -> list[tuple[int, int, bool]]:
    """Pieces of range ``no`` of a text, told by the slice of it that starts at ``base`` and holds the range and its halos."""
    begin, stop = no * size, min((no + 1) * size, total)
    a = 0 if no == 0 else _anchor(text, base, begin, limit, False)[0]
    b, natural = _anchor(text, base, stop, limit, stop == total)
    if no and a >= b:
        return []
    cuts = pieces(text, a - base, b - base, limit, overlap, no > 0)
    return [(s + base, e + base, forced or e + base == b and not natural) for s, e, forced in cuts]


def _slice(no: int, total: int, limit: int, size: int) -> tuple[int, int]:
    """Where the slice of a range starts and ends, halos included."""
    return max(0, no * size - 2 * limit), min(total, (no + 1) * size + 2 * limit)


def split_ranges(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """The boundary table: (``key``, uid, no, bounds), a row for each range with the pieces that begin in it.

    Texts of a few ranges are cut where they are read. Of longer ones the task that reads them only writes slices, walking
    through the text once, and the slices are cut by all tasks.
    """
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    kind = df.schema[key].dataType.simpleString()
    bounds = "bounds array<struct<s:int,e:int,forced:boolean>>"
    few = F.length("t") <= NEAR * size
    named = lambda cuts: [{"s": s, "e": e, "forced": f} for s, e, f in cuts]

    def here(batch: Iterator[tuple]) -> Iterator[tuple]:
        for uid, k, t in batch:
            for no in range(max(1, -(-len(t) // size))):
                low, high = _slice(no, len(t), limit, size)
                yield (uid, k, no, named(_cut(low, t[low:high], no, len(t), limit, overlap, size)))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(2)[i].as_py()
                for no in range(-(-len(t) // size)):
                    low, high = _slice(no, len(t), limit, size)
                    cols = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([no], pa.int32()), pa.array([len(t)], pa.int32()), pa.array([t[low:high]])]
                    yield pa.RecordBatch.from_arrays(cols, names=["uid", "k", "no", "total", "slice"])

    def there(batch: Iterator[tuple]) -> Iterator[tuple]:
        for uid, k, no, total, t in batch:
            yield (uid, k, no, named(_cut(_slice(no, total, limit, size)[0], t, no, total, limit, overlap, size)))

    near = map_rows(rows.filter(few), here, f"uid long, k {kind}, no int, {bounds}")
    far = rows.filter(~few).mapInArrow(slices, struct(f"uid long, k {kind}, no int, total int, slice string")).repartition("uid", "no")
    return near.unionByName(map_rows(far, there, f"uid long, k {kind}, no int, {bounds}")).withColumnRenamed("k", key)


def numbered(ranges: DataFrame, key: str) -> DataFrame:
    """Pieces with their number in the text: pieces of earlier ranges, a prefix sum over the boundary table, plus the place in the range."""
    n = F.size("bounds")
    before = F.coalesce(F.sum(n).over(Window.partitionBy("uid").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("before", before).select(key, "uid", "before", F.posexplode("bounds").alias("i", "b"))
    return placed.select(key, "uid", (F.col("before") + F.col("i")).cast("int").alias("piece"), F.col("b.s").alias("start_char"), F.col("b.e").alias("end_char"), F.col("b.forced").alias("forced"))


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Pieces of every text: (``key``, uid, piece, start_char, end_char, forced), offsets in code points.

    ``uid`` tells rows apart that share a key. Consecutive pieces share about ``overlap`` characters, also where a range of
    ``size`` ends: there a piece may start before a short one that it follows. Less is shared only where a run without
    white space, punctuation or symbol leaves no room. A text within the limit is one piece, an empty text one empty piece; null texts have
    none. Repeated rows are split again under their own uid. ``forced`` marks a cut inside a run of more than ``limit``
    characters without white space, punctuation or symbol. Other columns are ignored; an empty table gives an empty one.
    """
    return numbered(split_ranges(df, key, text, limit, overlap, size), key)


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Keys whose text had to be cut, from its numbered pieces: (``key``, kind), 'oversized' for a text with a second piece,
    and 'no_boundary' where a cut was forced."""
    cut = split_texts(df, key, text, limit, overlap)
    kinds = F.array_compact(F.array(F.when(F.col("piece") > 0, "oversized"), F.when(F.col("forced"), "no_boundary")))
    return cut.select(key, F.explode(kinds).alias("kind")).distinct()


def _opened(uri: str):  # noqa: ANN202
    """A file by its URI or path, on any file system that the Arrow library reads, and its size."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path), system.get_file_info(path).size


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """Pieces of giant UTF-8 files, named by URI on a file system that all workers reach: (path, piece, start_byte, end_byte, forced).

    A worker reads the bytes of its range and the halos only. Neighbours share the overlap as in ``split_texts``. Pieces end
    at byte offsets of whole characters. Counts of pieces, summed over the boundary table, number them.
    """
    sizes = [(p, _opened(p)[1]) for p in paths]
    ranges = spark.createDataFrame(sizes, "path string, total long").withColumn(
        "no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("total") - 1) / size).cast("int"))))
    )
    # A range is a task's work, whatever the size of its row.
    count = sum(max(1, -(-n // size)) for _, n in sizes)
    ranges = ranges.repartition(max(1, min(count, TASKS)), "path", "no")
    halo = 4 * limit

    def split(rows: Iterator[tuple]) -> Iterator[tuple]:
        for path, total, no in rows:
            file, _ = _opened(path)
            with file:

                def anchor(at: int) -> int:
                    if at <= 0 or at >= total:
                        return max(0, min(at, total))
                    low = max(0, at - halo)
                    raw = file.read_at(min(total, at + halo) - low, low)
                    skip = next(i for i in range(4) if i >= len(raw) or raw[i] & 0xC0 != 0x80)
                    near = raw[skip:].decode("utf-8", "ignore")
                    cut = _best(near, 0, len(near))
                    cut = cut if cut > 0 else len(near) // 2
                    return low + skip + len(near[:cut].encode())

                a, b = anchor(no * size), anchor(min((no + 1) * size, total))
                if no and a >= b:
                    yield (path, no, [])
                    continue
                low = max(0, a - 8 * overlap) if no else a
                before, raw = file.read_at(a - low, low), file.read_at(b - a, a)
            skip = next(i for i in range(4) if i >= len(before) or before[i] & 0xC0 != 0x80)
            head = before[skip:].decode("utf-8", "replace")
            body = head + raw.decode("utf-8", "replace")
            at, chars = low + skip, 0
            places = {0: at}
            cuts = list(pieces(body, len(head), len(body), limit, overlap, no > 0))
            for p in sorted({x for s, e, _ in cuts for x in (s, e)}):
                at += len(body[chars:p].encode())
                chars = p
                places[p] = at
            yield (path, no, [{"s": places[s], "e": places[e], "forced": forced} for s, e, forced in cuts])

    cut = map_rows(ranges.select("path", "total", "no"), split, "path string, no int, bounds array<struct<s:bigint,e:bigint,forced:boolean>>")
    out = numbered(cut.withColumn("uid", F.col("path")), "path")
    return out.select("path", "piece", F.col("start_char").alias("start_byte"), F.col("end_char").alias("end_byte"), "forced")
