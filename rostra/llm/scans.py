"""Repair of text from scanned pages: broken words, misread characters, running headers and page numbers.

Lines are judged page by page, digits masked; words are grouped over the whole corpus by the skeleton that confusable
glyphs leave, and a rare form gives way to a form that the group supports: the one that the same document writes
elsewhere, else the most frequent. Paragraphs are reflowed with SQL windows over the lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.runtime import checkpointed, map_rows, small_rows

# Glyphs and glyph pairs that scanners take for each other, by the primitive strokes they share.
STROKES = {
    "m": "rri", "n": "ri", "u": "ii", "h": "li", "b": "li", "6": "li", "d": "cl", "w": "vv", "t": "l", "1": "l", "!": "i", "|": "l",
    "e": "c", "f": "s", "ſ": "s", "5": "s", "0": "o", "g": "q", "9": "q", "8": "li",
}
HYPHENS = "¬‐\xad-"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: A form gives way to the best form of its skeleton if that is so many times as frequent.
RATIO = 12
#: A form of clean text stands by itself unless the best form is so many times as frequent: clean texts have slips too.
SLIP = 1000
#: Texts whose pages a line has to head, digits masked, to be a header wherever it stands.
PAGES = 3
#: So many of the most frequent forms are sent to every task, which then does not ask for them; it only saves work.
KNOWN = 200_000

_STROKE = str.maketrans(STROKES)
_TOKEN = re.compile(r"!?[^\W_](?:[^\W_]|!(?=[^\W_])|['’\-](?=[^\W_]))*")
_JOIN = re.compile(rf"([^\W_][^\s—–“”()]*?)[{HYPHENS}][ \t]*\n(\S+)")
_ENDING = re.compile(rf"\S+[{HYPHENS}][ \t]*\n\s*\S+")
_BREAK = re.compile("\r\n|[\n\r\f]")
# A month may be misread too; then the brackets or the dash tell the date.
_DATE = re.compile(rf"[{{\[(]\d{{1,2}}\.? \S{{3,9}} \d{{4}}[}}\])]|(?<=— )\d{{1,2}} \S{{3,9}} \d{{4}}$|\d{{1,2}}\.? (?i:{MONTHS})\.? \d{{4}}")
_SPACED = re.compile(r"\S(?: \S)+(?:  +\S(?: \S)*)*$")
_EDGE = frozenset(" \t.[]{}()—–-0123456789")
_EDGES = re.compile(r"^(?:[\s.\[\]{}()—–-]|\d+(?=\s|$))+|[\s\d.\[\]{}—–-]+$")
_NUMBER = re.compile(r"(?:[\[({—–\-]\s*)?(?:(?:[Pp]age|[Pp]\.|[Pp]g\.?)\s*)?(?:\d{1,5}|[ivxlc]{1,9}|[IVXLC]{1,9})(?:\s*[\])}—–\-]| \.)?$")
_COLUMN, _COLUMN_END = re.compile(r"\d{1,5}(?:\s{2,}|\t)\S"), re.compile(r"\S\s{2,}\d{1,5}$")
_LISTED = re.compile(r"[,;]|^\d+(?:st|nd|rd|th)\b")
# Words that a title writes small, and marks that no title ends with.
_SMALL = frozenset("of the from in and for on to a at upon with by de or".split())
_STOPS = frozenset(".,;?!”-¬‐\xad")
_PLAIN = re.compile(r"[a-z]+(?:['’-][a-z]+)*$")


def skeleton(word: str) -> str:
    """What a word shares with its misreadings: accents dropped, glyphs replaced by their strokes."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("’", "'")
    return word.lower().translate(_STROKE)


def _vocabulary(rows: Iterator[tuple]) -> Iterator[tuple]:
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text, clean in rows:
        if not clean:
            text = _ENDING.sub("\n", text)
        counts[bool(clean)].update(_TOKEN.findall(text))
    for clean, words in counts.items():
        lower: Counter = Counter()
        for w, n in words.items():
            if not w.isdigit():
                lower[w.lower()] += n
        for w, n in lower.items():
            yield (w, skeleton(w), n, n if clean else 0)


def vocabulary(rows: DataFrame, text: str, clean: Column) -> DataFrame:
    """Forms of the corpus: (form, skel, n, n_clean), n_clean counting text that was never scanned.

    Each batch brings its own counts, so a word of any frequency is a few rows when it is shuffled.
    """
    counted = map_rows(rows.select(F.col(text), clean).filter(F.col(text).isNotNull()), _vocabulary, "form string, skel string, n long, n_clean long")
    return counted.groupBy("form", "skel").agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean"))


def glyph_groups(words: DataFrame) -> DataFrame:
    """Per skeleton: the best plain form, its count, and the forms that stand in their own right.

    Both are rates, not single occurrences, so that they mean the same in a corpus of any size: clean text speaks for a
    form that it has in a twentieth of its places, and for one that is not ``SLIP`` times as rare as the best.
    """
    plain = F.col("form").rlike(_PLAIN.pattern.replace("$", "")) & ~F.col("form").rlike(r"[^a-z'’\-]")
    clean = (F.col("n_clean") > 0) & (F.col("n_clean") * 20 >= F.col("n"))
    scored = words.withColumn("rank", F.when(plain, F.struct(clean.alias("c"), F.col("n").alias("n"), F.col("form").alias("form"))))
    groups = scored.groupBy("skel").agg(
        F.max("rank").alias("top"), F.collect_list(F.when(plain, F.struct("form", "n", "n_clean"))).alias("forms")
    ).filter("top is not null and (top.n >= 2 or top.c)")
    # A group holds the spellings of one skeleton, a handful; only those that can stand by themselves are kept.
    stands = lambda x: (x["n_clean"] > 0) & (x["n_clean"] * SLIP >= F.col("top.n")) | (x["n"] * RATIO > F.col("top.n"))
    return groups.select("skel", F.col("top.form").alias("best"), F.col("top.n").alias("best_n"), F.transform(F.filter("forms", stands), lambda x: x["form"]).alias("valid"))


def _core(body: str) -> tuple[str, bool, bool]:
    """The title matter of a line: digits masked, dates and numbers off, spaced letters closed up; is it spaced, has it a date?"""
    spaced = len(body) > 4 and body[1] == " " and _SPACED.match(body) is not None
    core = " ".join(x.replace(" ", "") for x in re.split(r"\s{2,}", body)) if spaced else body
    shown = False
    if any(map(str.isdigit, body)):
        shown = _DATE.search(body) is not None
        core = _DATE.sub("", core)
    return (_EDGES.sub("", core) if core and (core[0] in _EDGE or core[-1] in _EDGE) else core), spaced, shown


def _title(core: str, body: str) -> bool:
    """Is every word in capitals, but for small words inside?"""
    if not core or body[-1] in _STOPS:
        return False
    first, *rest = core.split(" ")
    first = first[1:] if first[:1] in tuple('(“"') and first else first
    if not first or not (first[0].isupper() or first[0] in "0123456789!" and any(map(str.isalpha, first[1:]))) or any(map(str.isspace, first)):
        return False
    if core.rpartition(" ")[2] in _SMALL:
        return False
    for word in rest:
        lead = word[1:2] if word[:1] == "(" else word[:1]
        if not word or not (lead.isupper() or word[0] in "0123456789!" or word in _SMALL or word in "&—") or any(map(str.isspace, word)):
            return False
    return True


def page_lines(text: str) -> list[tuple[str, str, str | None]]:
    """Lines of a page as (body, kind, core): text, blank, header or pageno, and the masked title matter of what may be a header.

    A header has the title matter of a page: its masked core stands again on the page, or a date, column number or spacing
    shows it, or it had room for the next word of the running text and did not take it. What has only the form of title
    matter is left to its recurrence in the corpus.
    """
    bodies = [x.strip() for x in _BREAK.split(text)]
    width, count = max(map(len, bodies)), len(bodies)
    if count < 2:
        return [(b, "text" if b else "blank", None) for b in bodies]
    numbered = [0 < len(b) <= 24 and _NUMBER.match(b) is not None for b in bodies]
    cores: dict[int, tuple[str, bool, bool, bool]] = {}
    for i, body in enumerate(bodies):
        if not body or numbered[i]:
            continue
        # Running text is told at once: a small letter begins the line, and no figure or spacing speaks for a header.
        if body[0].islower() and body[1:2] != " " and not any(map(str.isdigit, body)):
            continue
        core, spaced, shown = _core(body)
        title = _title(core, body)
        if title or spaced or shown:
            cores[i] = core, spaced, shown and len(core) <= 60, title
    again = Counter(core.lower() for core, _, _, title in cores.values() if title)
    masked: dict[int, str] = {}
    kinds = ["blank" if not b else "pageno" if n else "text" for b, n in zip(bodies, numbered)]
    for i, (core, spaced, shown, title) in cores.items():
        body = bodies[i]
        after = next((bodies[j].split(None, 1)[0] for j in range(i + 1, min(i + 9, count)) if bodies[j] and not numbered[j]), "")
        # A line that had room for the next word is no line of running text, unless a paragraph ends there.
        room = len(body) + 1 + len(after) <= width
        loose = not (i and bodies[i - 1]) and not (i + 1 < count and bodies[i + 1])
        bare = title and not _LISTED.search(core) and len(core) > 3 and len(body) <= 70 and (room or loose or again[core.lower()] > 1)
        columned = title and (_COLUMN.match(body) or _COLUMN_END.search(body))
        if shown and (room or loose or title) or columned or spaced and len(core) > 3 or bare:
            kinds[i] = "header"
        if kinds[i] == "header" or title and len(core) > 3 and len(body) <= 70:
            masked[i] = re.sub(r"\d+", "#", core.lower())
    return [(b, kind, masked.get(i)) for i, (b, kind) in enumerate(zip(bodies, kinds))]


def _recurring(heads: DataFrame, key: str, core: str) -> DataFrame:
    """Masked title matter that heads the pages of at least ``PAGES`` texts: (``core``, often)."""
    return heads.groupBy(core).agg(F.count_distinct(key).alias("_n")).filter(F.col("_n") >= PAGES).select(core, F.lit(True).alias("often"))


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of the set texts with their kind: (uid, key, line, body, kind in text, blank, header, pageno)."""
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())

    def lay(batch: Iterator[tuple]) -> Iterator[tuple]:
        for uid, k, t in batch:
            for line, (body, kind, core) in enumerate(page_lines(t)):
                yield (uid, k, line, body, kind, core)

    lines = map_rows(rows, lay, f"uid long, k {df.schema[key].dataType.simpleString()}, line int, body string, kind string, core string")
    often = _recurring(lines.filter("kind = 'header'"), "k", "core")
    named = lines.join(often, "core", "left")
    return named.select("uid", "k", "line", "body", F.when((F.col("kind") == "text") & F.col("often"), "header").otherwise(F.col("kind")).alias("kind"))


def _marks(known: Broadcast):
    def marks(rows: Iterator[tuple]) -> Iterator[tuple]:
        strokes: dict[str, str] = {}

        def stroke(word: str) -> str:
            if (skel := strokes.get(word)) is None:
                if len(strokes) > 500_000:
                    strokes.clear()
                skel = strokes[word] = skeleton(word)
            return skel

        for k, text in rows:
            lines = page_lines(text)
            for line, kind, core in lines:
                if kind in ("header", "pageno"):
                    yield (k, kind, line, core, None, None, None)
                elif core is not None:
                    yield (k, "maybe", line, core, None, None, None)
            body = "\n".join(line for line, kind, _ in lines if kind == "text")
            if not body:
                continue
            for m in _JOIN.finditer(body):
                left, right = m[1], _TOKEN.match(m[2].lstrip("“\"'("))
                if right and m[2][-1] not in HYPHENS and not left.isdigit():
                    right = right[0]
                    joined, kept = left + right, f"{left}-{right}"
                    yield (k, "hyphen", joined.lower(), stroke(joined), ("^" if right[0].isupper() else "") + kept.lower(), stroke(kept), None)
            words = {*_TOKEN.findall(_JOIN.sub("\n", body).lower())}
            odd = [w for w in words - known.value if len(w) > 1 and not w.isdigit()]
            if not odd:
                continue
            # Words of one skeleton that the document writes elsewhere, the context that speaks for a form.
            near: dict[str, list[str]] = {}
            for w in words:
                near.setdefault(stroke(w), []).append(w)
            for w in odd:
                yield (k, "misread", w, stroke(w), None, None, [x for x in near[stroke(w)] if x != w])

    return marks


def _repairs(df: DataFrame, key: str, text: str, scanned: Column) -> DataFrame:
    """Every mark of the scanned rows with its right word: (k, kind, form, fixed, changed)."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(scanned, F.lit(False)).alias("s"))
    words = checkpointed(vocabulary(rows, "t", ~F.col("s")))
    frequent = words.filter("n_clean > 0 and form not rlike '[^a-z]'").orderBy(F.desc("n_clean"), "form").limit(KNOWN)
    known = df.sparkSession.sparkContext.broadcast({r["form"] for r in small_rows(frequent.select("form"), KNOWN, "known words")})
    pages = rows.filter("s and t is not null").select("k", "t")
    kind = df.schema[key].dataType.simpleString()
    marks = map_rows(pages, _marks(known), f"k {kind}, kind string, form string, skel string, kept string, kept_skel string, near array<string>").distinct()
    marks = checkpointed(marks)
    # A line that may be a header is one if its masked matter heads the pages of other texts.
    often = _recurring(marks.filter("kind = 'header'"), "k", "skel")
    heads = marks.filter("kind in ('header', 'maybe')").join(often, "skel", "left").filter("kind = 'header' or often").select("k", F.lit("header").alias("kind"), "form", F.lit(None).cast("string").alias("skel"), "kept", "kept_skel", "near")
    marks = marks.filter("kind not in ('header', 'maybe')").unionByName(heads)
    # What needs no lookup gets a key of its own that no group has, so that it spreads over the partitions.
    own = lambda c: F.coalesce(c, F.concat(F.lit("\0"), "form"))
    marks = marks.withColumn("skel", own("skel")).withColumn("kept_skel", own("kept_skel"))
    groups = glyph_groups(words)
    other = groups.select(F.col("skel").alias("kept_skel"), F.col("best").alias("kept_best"), F.col("best_n").alias("kept_n"), F.col("valid").alias("kept_valid"))
    found = marks.join(groups, "skel", "left").join(other, "kept_skel", "left")
    right = lambda form, best, valid: F.when(best.isNull() | F.array_contains(valid, form), form).otherwise(best)
    kept = F.regexp_replace("kept", r"^\^", "")
    as_compound = (F.col("kind") == "hyphen") & (
        (F.coalesce("kept_n", F.lit(0)) > F.coalesce("best_n", F.lit(0))) | (F.col("kept").startswith("^") & F.col("best").isNull())
    )
    plain = F.when(as_compound, kept).otherwise(F.col("form"))
    fixed = F.when(as_compound, right(kept, F.col("kept_best"), F.col("kept_valid"))).otherwise(right(F.col("form"), F.col("best"), F.col("valid")))
    beside = F.array_max(F.array_intersect("near", "valid"))
    own_form = (F.col("kind") == "misread") & ~F.array_contains("valid", F.col("form")) & beside.isNotNull()
    fixed = F.when(F.col("kind").isin("header", "pageno"), F.col("form")).when(own_form, beside).otherwise(fixed)
    return found.select("k", "kind", "form", fixed.alias("fixed"), (fixed != plain).alias("changed"))


def scan_marks(df: DataFrame, key: str, text: str, scanned: Column) -> DataFrame:
    """What page and scanner added to the scanned rows, and the right words: distinct (``key``, kind, fixed).

    Kinds: 'hyphen' and 'misread' with the right word in lower case, 'header' and 'pageno' with the line. Rows that are
    not ``scanned`` only count as corpus. Null and empty texts give nothing, repeated rows give their marks once, a null
    key is kept; other columns are ignored, an empty table gives an empty one.
    """
    rows = _repairs(df, key, text, scanned)
    kinds = F.array_compact(F.array(F.when(F.col("kind") != "misread", F.col("kind")), F.when(F.col("kind").isin("misread", "hyphen") & F.col("changed"), "misread")))
    return rows.select("k", F.explode(kinds).alias("kind"), "fixed").distinct().withColumnRenamed("k", key)


def _cased(word: str, like: str) -> str:
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:] if like[:1].isupper() else word


def _mend(rows: Iterator[tuple]) -> Iterator[tuple]:
    for k, uid, para, lines, fixes in rows:
        right = dict(fixes or ())

        def join(m: re.Match) -> str:
            token = _TOKEN.match(m[2].lstrip("“\"'("))
            if not token or m[2][-1] in HYPHENS:
                return m[1] + m[2] + "\n"
            whole = m[1] + token[0]
            return _cased(right.get(whole.lower(), whole), m[1]) + m[2].lstrip("“\"'(")[token.end() :] + "\n"

        body = " ".join(_JOIN.sub(join, "\n".join(lines)).split())
        yield (k, uid, para, _TOKEN.sub(lambda m: _cased(right[w], m[0]) if (w := m[0].lower()) in right else m[0], body))


def paragraphs(df: DataFrame, key: str, text: str, scanned: Column) -> DataFrame:
    """Readable paragraphs of the scanned rows: (``key``, uid, para, body), ``uid`` telling rows of one key apart.

    Page matter is gone, a paragraph that a page break cuts goes on, broken and misread words are mended. A blank line
    ends a paragraph, but for one beside page matter after a line that does not end a sentence.
    """
    lines, marks = line_table(df.filter(F.coalesce(scanned, F.lit(False))), key, text), _repairs(df, key, text, scanned)
    at = Window.partitionBy("uid").orderBy("line")
    is_text = F.col("kind") == "text"
    seen = lines.withColumns({
        "texts": F.sum(is_text.cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1)),
        "before": F.last(F.when(is_text, F.col("body")), True).over(at.rowsBetween(Window.unboundedPreceding, -1)),
    })
    gap = Window.partitionBy("uid", "texts")
    seen = seen.withColumns({"blank": F.max((F.col("kind") == "blank").cast("int")).over(gap), "page": F.max(F.col("kind").isin("header", "pageno").cast("int")).over(gap)})
    ended = F.col("before").rlike(r"[.?!:”\"')\]]$")
    opens = (F.col("blank") == 1) & F.col("before").isNotNull() & (ended | (F.col("page") == 0))
    placed = seen.filter(is_text).withColumn("para", F.sum(opens.cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    paras = placed.groupBy("uid", "para").agg(F.first("k").alias("k"), F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]).alias("lines"))
    one = marks.filter("kind = 'hyphen' or changed").groupBy("k", "form").agg(F.max("fixed").alias("fixed"))
    fixes = one.groupBy(F.col("k").alias("_k")).agg(F.collect_list(F.array("form", "fixed")).alias("fixes"))
    joined = paras.join(fixes, F.col("k").eqNullSafe(F.col("_k")), "left").select("k", "uid", "para", "lines", "fixes")
    kind = df.schema[key].dataType.simpleString()
    return map_rows(joined, _mend, f"k {kind}, uid long, para long, body string").withColumnRenamed("k", key)
