"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

A full stop is judged from unambiguous occurrences elsewhere: first in the same document, then in the corpus, and
last from a short lexicon of abbreviations. Terminators that are unambiguous in a script need no such evidence.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.runtime import checkpointed, map_rows

# Abbreviations that stand before a name and never end a sentence.
TITLES = frozenset(
    "Mr Mrs Ms Dr Prof Rev Revd Capt Col Gen Maj Lt Sgt Brig Adm Cmdr Messrs Mme Mlle Hon hon Rt rt Ven Rt.Hon "
    "Sr Sra Srta Dña Hr Fr Frl Sig Dott St Ste Sta Bros Pte Cpl Supt Insp Gov Sen Rep Pres "
    "г-н г-жа д-р проф им ул κ κα κκ δρ Δρ د أ م डॉ प्रो श्री पं".split()
)
# Abbreviations that stand before a number.
NUMBERED = frozenset(
    "t tt No Nos Nr Nrn núm nº Cmd Cmnd Cd p pp vol vols Vol Vols Col Cols col cols art Art sec Sec ch Ch cap Fig fig ff fol par para "
    "ст стр гл рис § αρ σελ Abs Bd S".split()
)
# Abbreviations that announce something and never end a sentence.
OPENING = frozenset("i.e e.g ie eg cf viz vs z d.h e.e h.y т.е т е напр δηλ π.χ π p.ej vgl т.к".split())
# Months that follow a day written as an ordinal with a full stop.
ORDINAL_NEXT = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert".split())
MONTHS = frozenset("Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec".split())
CLOSERS = "\"'”’»)\\]」』）】〕〉》›"
PAIRS = {"“": "”", "„": "“”", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", '"': '"', "‘": "’", "'": "'", "‹": "›"}
BRACKETS = frozenset("([（【")
CLOSED_WIDE = "」』）】》"
#: Facts of the corpus about a word, as bits: an abbreviation; an abbreviation before names; a word of the lower case.
ABBR, TITLE, LOWER = 1, 2, 4
#: Facts up to which every task gets all; beyond, each document gets those of its own words by a join, with one result.
FACTS = 1_000_000

_LINES = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_SITE = re.compile(rf"[.!?…]+(?:[{CLOSERS}]+|[\s]+[»›])*(?=\s|$|[぀-ヿ㐀-鿿])|[。！？｡]+[{CLOSERS}]*|[।॥؟۔։።፧။།]+[{CLOSERS}]*|[;;][{CLOSERS}]*(?=\s|$)")
_QUOTE = re.compile(r"[“„«(\[「『（【《\"‘'‹]")
_BEFORE = re.compile(r"[^\s(\[“„«‘\"']*$")
_OPENS = {"(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》"}
_BRACKET = re.compile("[" + re.escape("".join(_OPENS) + "".join(_OPENS.values())) + "]")
_NO_MARKS = re.compile(r"[฀-໿ក-៿]")
_NO_MARKS_GAP = re.compile(r"(?<=\S)\s+(?=\S)")
_ARTICLE = re.compile(r"(?:^|\W)(?:le|la|les|l|du|au|ce|un|et|voir|sous|selon|of|in|the|see)\W+$", re.I)
_STOPPED = re.compile(r"(?<![^\s(\[“\"'])([^\W\d_]++)\.(?:([,;:])|\s+([^\W\d_]+))")
_WORD = re.compile(r"([^\W\d_]++)(\.?)(?=(\s*)(\S?))")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
# Words by which a sentence goes on behind a quotation, in Chinese.
_WIDE_AFTER = ("随后", "然后", "接着", "于是", "并", "但", "而", "便", "就", "说", "道", "的")
_WIDE_ON = frozenset("とってのはがをにもへで，、,")


def _brackets(line: str) -> dict[int, int]:
    """Places of opening brackets and of what closes them, from one pass."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = defaultdict(list)
    for m in _BRACKET.finditer(line):
        c = m[0]
        if c in _OPENS:
            open_[_OPENS[c]].append(m.start())
        elif open_[c]:
            out[open_[c].pop()] = m.start()
    return out


def _spans(line: str) -> list[tuple[int, int]]:
    """Outermost quoted and bracketed spans of a line that are closed in it, as (start, end exclusive)."""
    spans, at = [], 0
    pairs = None
    hopeless: set[str] = set()  # marks that nothing closes any more
    while m := _QUOTE.search(line, at):
        i, mark = m.start(), m[0]
        at = i + 1
        before = line[i - 1] if i else " "
        if mark in hopeless or mark in "'‘\"" and (before.isalnum() or before in ".,!?"):
            continue
        closers, end = PAIRS[mark], -1
        if mark in _OPENS:
            pairs = _brackets(line) if pairs is None else pairs
            end = pairs.get(i, -1)
        else:
            if mark in "'‘":
                j = i
                while (j := line.find(closers, j + 1)) > 0:
                    if line[j - 1] in ".,!?…;:" and not line[j + 1 : j + 2].isalnum():
                        end = j
                        break
            else:
                ends = [j for c in closers if (j := line.find(c, i + 1)) > 0]
                end = min(ends) if ends else -1
            if end < 0:
                hopeless.add(mark)
        if end > 0:
            spans.append((i, end + 1))
            at = end + 1
    return spans


class Judge:
    """Decides full stops of one document; ``corpus`` has the facts of words, as bits."""

    def __init__(self, text: str, corpus: Mapping[str, int]):
        self.text, self.corpus, self._words = text, corpus, None

    def words(self) -> tuple[set[str], set[str], set[str], set[str], set[str]]:
        """What the document shows without doubt, from one pass over it: words written with a full stop where no sentence
        can end; words without one; those not even before a name or number; words in lower case; words inside a sentence."""
        if self._words is None:
            stopped, bare, plain, lower, inside = set(), set(), set(), set(), set()
            for m in _WORD.finditer(self.text):
                word, dot, gap, after = m.groups()
                if dot:
                    if after and (after in ",;:" and not gap or gap and after.islower()):
                        stopped.add(word)
                else:
                    bare.add(word)
                    if not (gap and (after.isupper() or after.isdigit())):
                        plain.add(word)
                if word[0].islower():
                    lower.add(word)
                elif (at := m.start()) > 1 and self.text[at - 1] == " " and ((c := self.text[at - 2]).islower() or c in ",;"):
                    inside.add(word)
            self._words = stopped, bare, plain, lower, inside
        return self._words

    def proper(self, word: str) -> bool:
        """Is a capitalised word a name here: written so inside a sentence, and nowhere in lower case?"""
        *_, lower, inside = self.words()
        return word in inside and word.lower() not in lower

    def opens(self, word: str) -> bool:
        """Is a capitalised word one of the lower case, here or in the corpus, so that a sentence opens with it?"""
        return not word or not word[0].isupper() or word.lower() in self.words()[3] or bool(self.corpus.get(word.lower(), 0) & LOWER)

    def ends(self, token: str, nxt: str, word: str, lead: str) -> bool:
        """Does a full stop after ``token`` end a sentence, if ``nxt`` is the first character of what follows, ``word`` its first word, and ``lead`` stands before the token?"""
        if nxt.islower():
            return False
        tail = token.rpartition("-")[2] if token not in TITLES else token
        digit = nxt.isdigit()
        if tail.isalpha() and not digit:
            # What the document shows, of types of any length, then the corpus; the lexicon decides what they leave open.
            stopped, bare, plain, *_ = self.words()
            # One in capitals may stand before a name that the text has once; "etc." ends sentences as well.
            if tail in stopped and tail not in bare and (self.proper(word) or tail[0].isupper() and not self.opens(word)):
                return False
            if len(tail) > 1 and tail in plain and tail not in stopped:
                return True
            fact = self.corpus.get(tail, 0)
            if fact and tail not in bare and (fact & TITLE or fact & ABBR and self.proper(word)):
                return False
        if tail in TITLES or tail in OPENING:
            return False
        if tail == "no" and digit:  # a number in French, an answer in English
            return _ARTICLE.search(lead) is None
        if tail in NUMBERED and (digit or tail.islower() and len(tail) < 3 or re.fullmatch(r"[IVXLC]+", word)):
            return False if digit or word else True
        if word in ORDINAL_NEXT and len(tail) < 3 and tail.isdigit():
            return False
        if tail in MONTHS and digit:
            return False
        letters = tail.replace(".", "")
        if len(letters) == 1 and letters.isalpha() and letters.isupper() and "." not in tail:
            return False
        return True


def sentence_spans(text: str, corpus: Mapping[str, int]) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) in code points, without outer white space."""
    out: list[tuple[int, int]] = []
    judge = Judge(text, corpus)
    for part in _LINES.finditer(text):
        base, line = part.start(), part[0]
        size = len(line)
        spans = _spans(line) if _QUOTE.search(line) else []
        cuts = []
        events = [(m.start(), m.end(), m[0]) for m in _SITE.finditer(line)]
        if spans:
            events += [(b - 1, b, "") for a, b in spans if line[a] in BRACKETS]
            events.sort()
        unmarked = _NO_MARKS.search(line) is not None
        if unmarked:
            for m in _NO_MARKS_GAP.finditer(line):
                left = line[: m.start()].rsplit(None, 1)[-1]
                if _NO_MARKS.match(line, m.end()) and _NO_MARKS.search(left) or _NO_MARKS.search(left[-1]):
                    cuts.append(m.start())
        begin, k = 0, 0
        for a, b, mark in events:
            if a < begin:
                continue
            while k < len(spans) and spans[k][1] < b:
                k += 1
            inside = k < len(spans) and spans[k][0] < a and b < spans[k][1]
            if inside:
                continue
            opened = spans[k][0] if k < len(spans) and spans[k][0] < a < spans[k][1] else -1
            rest = b
            while rest < size and line[rest].isspace():
                rest += 1
            if rest >= size:
                continue
            first = rest
            while first < size and line[first] in "“„«([「『（【《\"‘'‹¿¡ \xa0":
                first += 1
            nxt = line[first] if first < size else ""
            if not mark:  # a bracket closes
                if opened < 0 or line[begin:opened].strip() or nxt.islower() or rest == b:
                    continue
                cuts.append(b)
                begin = b
                continue
            lead = mark[0]
            if lead in ";;":
                here = line[begin:a]
                if not (m := re.search(r"[^\W\d_]", here)) or not _GREEK.match(m[0]):
                    continue
            elif lead in "。！？｡" or rest == b:
                if mark[-1] in CLOSED_WIDE and rest == b:
                    if opened >= 0 and line[begin:opened].strip() and (line[opened - 1] not in "：:" or nxt in _WIDE_ON or line.startswith(_WIDE_AFTER, rest)):
                        continue
                    if nxt in _WIDE_ON:
                        continue
            elif lead in ".…" and ("…" in mark or mark.startswith("..")):
                if nxt.islower():
                    continue
            elif lead in "!?":
                if nxt.islower():
                    continue
            elif lead == ".":
                m = _BEFORE.search(line, max(begin, a - 40), a)
                word = re.match(r"\w*", line[first : first + 40])[0]
                if opened >= 0 and len(mark) > 1 and line[opened] not in BRACKETS:
                    if nxt.islower():
                        continue
                elif not judge.ends(m[0], nxt, word, line[max(begin, m.start() - 12) : m.start()]):
                    continue
            cuts.append(b)
            begin = b
        start = 0
        for cut in sorted({*cuts, size}):
            piece = line[start:cut]
            body = piece.strip()
            if body:
                lead = start + len(piece) - len(piece.lstrip())
                out.append((base + lead, base + lead + len(body)))
            start = cut
    return out


def _statistics(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Partial counts of a batch: (word, next, n, low, bare, lower, upper), ``next`` what stands in capitals after a full stop."""
    stops: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    words: Counter = Counter()
    for (t,) in rows:
        words.update(t.split())
        for m in _STOPPED.finditer(t):
            after = m[3] or ""
            low = bool(m[2]) or after[0].islower()
            n = stops[m[1], "" if low or not after[0].isupper() else after.lower()]
            n[0] += 1
            n[1] += low
    forms: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for w, n in words.items():
        core = w.strip(",;:()“”\"'.!?")
        if core.isalpha():
            forms[core.lower()][1 if core[0].islower() else 2] += n
            if w in (core, core + ","):
                forms[core][0] += n
    for (w, after), (n, low) in stops.items():
        yield (w, after, n, low, 0, 0, 0)
    for w, n in forms.items():
        yield (w, None, 0, 0, *n)


def corpus_facts(texts: DataFrame, text: str) -> DataFrame:
    """What the whole corpus shows of words: (word, facts).

    Every batch counts, Spark sums, so that no layout of the rows changes a fact: an abbreviation stands with a full stop
    where no sentence can end, and hardly ever without one; one before names is followed by words that hardly ever are in
    lower case; a word of the lower case is written so in a fifth of its places.
    """
    counts = map_rows(texts.select(F.col(text)).filter(F.length(text) > 0), _statistics, "word string, next string, n long, low long, bare long, lower long, upper long")
    sums = checkpointed(counts.groupBy("word", "next").agg(*(F.sum(c).alias(c) for c in ("n", "low", "bare", "lower", "upper"))))
    forms = sums.filter("next is null").select("word", "bare", "lower", "upper")
    cases = forms.select(F.col("word").alias("next"), (F.col("lower") * 20 <= F.col("lower") + F.col("upper")).alias("name"))
    stops = sums.filter("next is not null").join(cases, "next", "left")
    types = stops.groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum(F.when((F.col("next") != "") & F.coalesce("name", F.lit(True)), F.col("n")).otherwise(0)).alias("names"))
    both = types.filter("n >= 5").join(forms, "word", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    stopped = (zero("n") >= 5) & (zero("bare") * 20 <= F.col("n"))
    abbr = stopped & (F.col("low") * 5 >= F.col("n"))
    title = stopped & (F.col("names") * 10 >= F.col("n") * 9) & (F.initcap("word") == F.col("word")) & (F.length("word") > 1)
    lower = (zero("lower") >= 3) & (F.col("lower") * 5 >= F.col("lower") + F.col("upper"))
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return both.select("word", (bit(abbr, ABBR) + bit(title, TITLE) + bit(lower, LOWER)).alias("facts")).filter("facts > 0")


def _asked(text: str) -> set[str]:
    """Words of a text that a judge may look up."""
    return {w for m in _STOPPED.finditer(text) for w in (m[1], (m[3] or "").lower())} | {w.rpartition("-")[2] for w in re.findall(r"\S+(?=\.)", text)} | {w.lower() for w in re.findall(r"[^\W\d_]+", text)}


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences of every row: (``key``, start_char, end_char), each once for a key, in code points of ``text``.

    A row without text, or with nothing but white space, has no sentence; repeated rows give their sentences once; two
    texts under one key give the sentences of both. A null key is kept as a key. Other columns are ignored, whatever
    their names. An empty table gives an empty one. The facts of the corpus are counted when this is called.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    kind = df.schema[key].dataType.simpleString()
    facts = checkpointed(corpus_facts(rows, "t"))
    known = {r["word"]: r["facts"] for r in facts.limit(FACTS + 1).toLocalIterator()} if facts.limit(FACTS + 1).count() <= FACTS else None
    if known is not None:
        shared = df.sparkSession.sparkContext.broadcast(known)

        def split(batch: Iterator[tuple]) -> Iterator[tuple]:
            for k, t in batch:
                for a, b in sentence_spans(t, shared.value):
                    yield (k, a, b)

        out = map_rows(rows, split, f"k {kind}, start_char int, end_char int")
    else:

        def ask(batch: Iterator[tuple]) -> Iterator[tuple]:
            for t, d in batch:
                for w in _asked(t):
                    yield (d, w)

        def split_own(batch: Iterator[tuple]) -> Iterator[tuple]:
            for k, t, own in batch:
                for a, b in sentence_spans(t, dict(own or ())):
                    yield (k, a, b)

        digest = F.concat(F.hex(F.xxhash64("t")), F.md5("t"))
        marked = rows.withColumn("d", digest)
        asked = map_rows(marked.select("t", "d"), ask, "d string, word string").distinct()
        own = asked.join(facts, "word").groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("word", "facts"))).alias("own"))
        out = map_rows(marked.join(own, "d", "left").select("k", "t", "own"), split_own, f"k {kind}, start_char int, end_char int")
    return out.distinct().withColumnRenamed("k", key)
