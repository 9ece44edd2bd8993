"""Queries over worked examples: what SQL cannot compute has its result written out by hand, as a table of values."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra import speakers
from rostra.functions import answers, eras, names, text
from rostra.functions.vectors import normalised, soft_jaccard
from rostra.operators import clusters, metrics, reports, retrieval, stages, store
from rostra.plans import grids
from rostra.sources import html, nested

Query = Callable[[SparkSession, str], DataFrame]
_KINDS = {"VARCHAR": "string", "BIGINT": "long", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}


def _literal(x) -> str:  # noqa: ANN001
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(columns: dict[str, str], rows: Sequence[tuple]) -> str:
    """SQL of a table of values with typed columns."""
    picked = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in columns.items())
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({', '.join(columns)})"


def _cases(column: Callable, cases: Sequence[tuple], kind: str = "VARCHAR", ddl: str = "string") -> tuple[Query, str]:
    """A scalar function over inputs and what it has to give: (n, y)."""
    def run(s: SparkSession, _: str) -> DataFrame:
        df = s.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], f"n int, x {ddl}")
        return df.select("n", column(F.col("x")).cast(_KINDS[kind]).alias("y"))

    return run, values({"n": "INTEGER", "y": kind}, [(i, y) for i, (_, y) in enumerate(cases)])


def _python(read: Callable, kind: str) -> Callable:
    return lambda x: html.html_udf(read, kind)(x)


_list = lambda c: F.array_join(c, " / ", "null")

# ---- answers of models

_JSON = [
    ('{"mentions_topic": true, "subthemes": ["NHS funding", "waiting lists"], "evidence_quote": "the service"}', (True, "NHS funding / waiting lists", "the service", True, None, False, "NHS funding / waiting lists")),
    ('Here is the JSON:\n```json\n{"mentions_topic": false, "subthemes": [], "evidence_quote": ""}\n```', (False, "", "", True, None, False, "")),
    ('{"mentions_topic": false, "subthemes": ["poor law"], "evidence_quote": ""}', (False, "", "", True, None, False, "poor law")),
    ('{"mentions_topic": "Yes", "subthemes": []}', (True, "", "", True, None, False, "")),
    ("The speech is about railways.", (None, "", "", False, "no JSON object found", False, "")),
    (json.dumps({"mentions_topic": True, "subthemes": [f"theme {i}" for i in range(10)]}), (True, "theme 0 / theme 1 / theme 2 / theme 3 / theme 4", "", True, None, False, "theme 0 / theme 1 / theme 2 / theme 3 / theme 4")),
    ('{"mentions_topic": "perhaps", "subthemes": ["a"]}', (None, "", "", False, "missing/uninterpretable mentions_topic", False, "a")),
    ('say {"mentions_topic": 1, "evidence_quote": "a } in \\"text\\"", "subthemes": "rent; Rent | None, x (a, b)"} end', (True, "rent / x (a, b)", 'a } in "text"', True, None, False, "rent / x (a, b)")),
    ("  ", (None, "", "", False, "empty response", False, "")),
    (None, (None, "", "", False, "empty response", False, "")),
]
_FREE = [
    ("Yes, the speech substantively discusses health care.\n- hospital funding\n- nurse pay", (True, "hospital funding / nurse pay", "", True, None, False, "hospital funding / nurse pay")),
    ("Key themes:\n- workhouse conditions\n- outdoor relief", (True, "workhouse conditions / outdoor relief", "", True, None, True, "workhouse conditions / outdoor relief")),
    ("No. The speech concerns railway gauges.", (False, "", "", True, None, False, "")),
    ("No, this is not substantively about health care, though it touches on:\n- army sanitation", (False, "", "", True, None, False, "army sanitation")),
    ("mentions_topic: false\nNothing relevant.", (False, "", "", True, None, False, "")),
    ("An interesting speech about many things.", (None, "", "", False, "no yes/no signal in free text", False, "")),
    ("Substantive discussion: **Yes**\nSub-topics: rents, damp (walls, roofs). And more.", (True, "rents / damp (walls, roofs)", "", True, None, False, "rents / damp (walls, roofs)")),
    ('It covers care, and is not about rail. "the fever hospital of the town"', (True, "", "the fever hospital of the town", True, None, False, "")),
    ("It does not substantively discuss care; it covers rail.", (False, "", "", True, None, False, "")),
    ("1) one\n2. ONE\n• none", (True, "one", "", True, None, True, "one")),
    ("This is a substantive subject here.", (True, "", "", True, None, False, "")),
    ("", (None, "", "", False, "empty response", False, "")),
]
_ANSWER = {"n": "INTEGER", "mentions_topic": "BOOLEAN", "subthemes": "VARCHAR", "evidence_quote": "VARCHAR", "parse_ok": "BOOLEAN", "parse_error": "VARCHAR", "presence_inferred": "BOOLEAN", "subthemes_raw": "VARCHAR"}


def _answers(form: str, cases: list) -> tuple[Query, str]:
    def run(s: SparkSession, _: str) -> DataFrame:
        df = s.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "n int, t string").select("n", answers.parsed(F.col("t"), F.lit(form)).alias("p")).select("n", "p.*")
        return df.withColumns({c: _list(c) for c in ("subthemes", "subthemes_raw")})

    return run, values(_ANSWER, [(i, *want) for i, (_, want) in enumerate(cases)])


def _reparse(s: SparkSession, _: str) -> DataFrame:
    rows = s.createDataFrame([
        (1, '{"mentions_topic": true, "subthemes": ["a"], "evidence_quote": "q"}', "json", "v1", None), (2, None, "json", "v1", "timeout"),
        (3, "Yes.\n" + "\n".join(f"- theme {i}" for i in range(12)), "free", "v1_nocap", None), (4, "Yes.\n" + "\n".join(f"- theme {i}" for i in range(12)), "free", "v1", None), (5, None, "free", "v1", None),
    ], "speech_id long, raw_text string, output_format string, task string, error string")
    return store.reparsed(rows).select("speech_id", "mentions_topic", F.size("subthemes").alias("themes"), "parse_ok", "parse_error")


# ---- texts

_SENTENCES = [
    ("Mr. A. B. Smith, e.g. of No. 3, paid 3.5 pounds. He said no. Then we left!\nNew line", "Mr. A. B. Smith, e.g. of No. 3, paid 3.5 pounds. / He said no. / Then we left! / New line"),
    ("It rose at 4 p.m. The vote, i.e. the U.K. vote, fell. An m.g. ended. Next.", "It rose at 4 p.m. The vote, i.e. the U.K. vote, fell. / An m.g. / ended. / Next."),
    ("The hon. Member of St. Ives asked: Why? Nos. 3 and 4!  Yes", "The hon. Member of St. Ives asked: Why? / Nos. 3 and 4! / Yes"),
    ("A p.s. came. It is vol. 3. Jan. was cold", "A p.s. / came. / It is vol. 3. / Jan. was cold"),
    (" \n\n ", ""), ("", ""),
]
_DATED = [
    ("Oxford March 3, 1901 - April 5, 1910", "Oxford | March 3, 1901 - April 5, 1910"), ("Oxford  March 3, 1901 –", "Oxford | March 3, 1901 –"), ("Baron Ox, of Ox July 12, 1888", "Baron Ox, of Ox | July 12, 1888"),
    ("Oxford 1901", "Oxford 1901 | null"), ("March 3, 1901", "March 3, 1901 | null"),
]
_INTRO = [
    ("Main text:\n\nBorn 1901, died 1950; in 1901.\n\nLater 1960.\n\nInfobox:", 2), ("Main text:", 0), ("1600 and 1599 and 2099 and 2100", 2), ("", 0), ("   ", 0),
]
_REPLIES = [
    ("Wikipedia URL: http://a/b\nWikidata URL: http://c", "http://a/b | http://c"), ("wikidata url:x", "Not found | x"), ("none", "Not found | Not found"), ("  WIKIPEDIA URL : http://q:8 \nWikipedia URL: http://r", "http://r | Not found"),
]
_BUDGETED = [("short", "short"), ("body " * 4 + "\nReferences\n" + "x" * 100, "body " * 4 + "\n"), ("y" * 200, None)]
_LISTS = [('["a", "b"]', "a / b"), ("['a', 'it''s']", "a / its"), ("['a', \"it's\"]", "a / it's"), ("[]", ""), ("", ""), (None, ""), ("nonsense", ""), ("{'a': 1}", ""), ("[1, None]", "1 / null"), ("[broken", "")]
_DATES = [
    ("1901", "1901-01-01"), ("1901-05", "1901-05-01"), ("1901-00-00", "1901-01-01"), ("1901-07-00", "1901-07-01"), ("3 March 1920", "1920-03-03"), ("1920-03-04", "1920-03-04"), ("?", ""), ("0999", ""), ("9999", ""), ("", ""),
]


def _queries(s: SparkSession, _: str) -> DataFrame:
    df = s.createDataFrame([(1, "Jo Lee", "1801 - 1850", "J. Lee (elder); Lee, Jo", None), (2, "Al", "", "", " ")], "n int, name string, dates string, other string, seats string")
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    return df.select("n", text.search_query(c("name"), c("dates"), lists=(F.col("other"), F.col("seats"))).alias("wide"), text.search_query(c("name"), c("dates")).alias("plain"))


def _templates(s: SparkSession, _: str) -> DataFrame:
    df = s.createDataFrame([("a", "care of the sick", "Care"), ("b", " ", "Care"), ("c", None, "Care")], "model string, description string, name string")
    asked = text.query_text(F.col("description"), F.col("name"))
    return df.select("model", asked.alias("query"), text.templated(asked, {"a": "query: {text}", "b": "Q {text}!"}, F.col("model")).alias("sent"))


def _labels(s: SparkSession, _: str) -> DataFrame:
    df = s.createDataFrame([(1, "https://Api.Host.org:8000/v1", None), (2, None, None), (3, "https://h/v1", "own"), (4, "not a link", "")], "n int, url string, label string")
    return df.select("n", text.backend_label(F.col("url"), F.col("label")).alias("backend"))


# ---- names

_CLEAN = [("Mr. John  Smith said", "john smith"), ("The Lord Advocate", "lord advocate"), ("Lord John Russell", "john russell"), (None, ""), ("*Sir R. Peel*", "sir r. peel"), ("the Earl of Derby asked", "earl of derby")]
_BLOCKS = [("john smith", "j-S530"), ("jon smyth", "j-S530"), ("robert", "r-R163"), ("", "")]
_GIVEN = {"ann": "female", "robin": "mostly_male", "lesley": "mostly_female", "john": "male"}
_SPEAKERS = [
    ("Mary Lord", None, "male"), ("Lord Mary", "male", None), ("Captain Sir John Lee", "male", "male"), ("Dr Ann Lee", "female", "female"), ("Hon. Q", "male", None), ("Lieut-Colonel Ann Ox", "female", "female"), ("Robin Ox", None, "male"),
    ("The Chancellor", None, None), ("Mrs. Ox", "female", None), ("Lesley Ox", None, "female"), ("Minister Ann", None, None), ("", None, None), ("John Ox", "male", "male"),
]
_ALIKE = [("john smith", "smith john", 100.0), ("mary ann jones", "mary jones", 100.0), ("abc", "xyz", 0.0), ("a", "", 0.0), ("john smith", "john smyth", 90.0), ("abcd", "abce", 75.0)]


def _genders(s: SparkSession, _: str) -> DataFrame:
    df = s.createDataFrame([(i, n) for i, (n, *_) in enumerate(_SPEAKERS)], "n int, x string")
    return df.select("n", names.speaker_gender(F.col("x"), _GIVEN, {"Hon. Q": "male"}).alias("listed"), names.spelling_gender(F.col("x"), _GIVEN).alias("spelled"))


def _people(s: SparkSession, _: str) -> DataFrame:
    rows = [("Mr. John Smith", "1900-01-01"), ("john smith said", "1901-01-01"), ("John Smyth", "1950-01-01"), ("Smith John", "1902-05-05"), ("Jane Jones", "1890-01-01"), ("Jane Jons", "1891-01-01"), ("  ", "1890-01-01"), (None, None), ("Ann Ox", "no day")]
    out = clusters.speakers(s.createDataFrame(rows, "speaker string, date string"))
    return out.select("person_id", "canonical_name", "aliases", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "gap_days", "n_variants", "n_rows")


# ---- pages

_INDEX = """<ol><span class="section-column-reference">c1</span><li><span class="section-link"><a href="/a">Army</a></span> <span class="section-word-length">90 words</span></li>
<span class="section-column-reference">c2</span><ol><li><span class="section-link"><a href="b">Pay</a></span></li><li>none</li></ol><li><span class="section-link"><a href="http://x/c">Navy</a></span></li></ol>"""
_SECTION = """<div class="hentry member_contribution"><cite class="member"><a href="/people/x">Mr. X</a></cite><p>One.</p><p>Two.</p></div>
<div class="hentry member_contribution"><cite class="member">Mr. Y</cite><p>Three.</p></div>"""
_CARD = """<h1 class="vcard">Mr. Jo Lee</h1> 1801 - 1850 <h2>Constituencies</h2><ol><li><a href="/s">Ox</a> March 3, 1820 - May 4, 1830</li></ol><h2>Titles in Lords</h2><ul><li>Baron Ox July 1, 1840</li><li>Peer</li></ul>
<h2>Notes</h2><p>Seen June 2, 1841 –</p><h2>Contributions</h2><ol><li>1820</li></ol>"""
_LETTER = '<ul><li><a href="/people/mr-lee">Mr. Jo Lee</a> 1801 - 1850</li><li>no link</li><li><a href="mr-ox">Ox</a></li></ul>'
_ARTICLE = """<div id="mw-content-text"><div class="mw-parser-output"><p> </p><p>Jo <b>Lee</b> was.</p><table class="infobox"><tr><th>Born</th><td>1801</td></tr><tr><th>Died</th><td></td></tr></table><h2>Life</h2><li>One</li></div></div>"""
_CALENDAR = '<a class="day-link" aria-label="Has business. Monday 3 March 1980">3</a><a class="day-link" aria-label="No">4</a><a class="day-link" aria-label="has business. Monday 3 March 1980">3</a><a class="day-link" aria-label="Has business. Tuesday 4 March 1980">4</a>'
_MENU = '<div class="dropdown-menu"><div>HTML Downloads</div><a class="dropdown-item" href="/d/1.html">HTML one</a><a class="dropdown-item" href="/d/1.html">HTML</a><a class="dropdown-item" href="/d/2.pdf">PDF</a></div>'
_DAY = """<div class="child-debate-list"><div class="child-debate"><h2>Care</h2><div class="debate-item"><p>Rose.</p></div><div class="debate-item"><div class="contribution"><a class="attributed-to-details" href="/m/1"><div class="primary-text">Jo</div><div class="secondary-text">Ox</div></a><div class="content"><p>One.</p><p>Two.</p></div></div></div>
<div class="child-debate-list"><div class="child-debate"><h3>Fees</h3><div class="debate-item"><div class="contribution"><div class="content"><p>Three.</p></div></div></div></div></div></div></div>"""


def _flat(tree: list[dict], depth: int = 0) -> list[str]:
    return [x for n in tree for x in (f"{depth}|{n['title']}|{n['url']}|{n['column']}|{n['word_length']}", *_flat(n["subsections"], depth + 1))]


def _told(tree: list[dict]) -> list[str]:
    out = []
    for n in tree:
        out += [f"{n['depth']}|{n['heading']}|item|{t}" for t in n["items"]] + [f"{n['depth']}|{n['heading']}|{c['speaker']}|{c['speaker_url']}|{' '.join(c['paragraphs'])}" for c in n["contributions"]]
        out += _told(n["subdebates"])
    return out


def _card(page: str) -> list[str]:
    found = html.speaker_page(page)
    return [f"{found['name']}|{found['dates']}", *(f"{k}|{e['content']}|{e['dates']}" for k, es in found["entries"].items() for e in es)] if found else ["no page"]


def _pages(read: Callable[[str], list[str]], pages: Sequence[str], want: Sequence[Sequence[str]]) -> tuple[Query, str]:
    """Lines that a reader finds on pages: (page, i, line)."""
    def run(s: SparkSession, _: str) -> DataFrame:
        df = s.createDataFrame(list(enumerate(pages)), "page int, html string")
        return df.select("page", F.posexplode(html.html_udf(read, "array<string>")("html")).alias("i", "line"))

    return run, values({"page": "INTEGER", "i": "INTEGER", "line": "VARCHAR"}, [(n, i, x) for n, lines in enumerate(want) for i, x in enumerate(lines)])


# ---- nested records

_TRANSCRIPTS = [
    json.dumps({"day": "1900-01-01", "data": {"chambers": {"c": [{"title": "A", "content": [{"speaker": "x", "text": "1"}], "subsections": [{"title": "B", "content": [{"speaker": "y", "speaker_url": "/y", "speech": "2"}]}]}, {"title": "C", "content": [{"speaker": "z"}]}]}}}),
    "", "[1]", "{broken",
]
_MEMBER = '{"id": 7, "nameDisplayAs": " ", "nameListAs": "Jo", "latestParty": {"abbreviation": "W"}}'
_BIO = {
    "name": "Jo L.", "date_of_birth": "1950-06", "political_career": {"first_elected": "1990", "ministerial_positions": ["A", "B"]},
    "party_affiliation": [{"party": " Lab ", "start_year": "1990", "end_year": None}, {"party": ""}, {"party": "None", "start_year": "1995.0", "end_year": "999"}],
    "constituencies": [{"seat": "Ox", "start": "1990", "end": "1995-00-00"}, {"seat": " ", "start": None, "end": "?"}],
    "education": {"school_name": "Ox School", "school_type": "", "universities": ["Ox ", {"university_name": "", "name": "Cam", "degree": "BA", "start_year": "1980"}]},
}


def _bios(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    bios = s.createDataFrame([("P1", "Jo Lee", "j. lee; jo lee", json.dumps(_BIO)), ("P2", "Al", None, "{broken"), ("P3", "Di", "", None)], "person_id string, canonical_name string, aliases string, bio string")
    return bios, s.createDataFrame([("jo lee", "Mr. Jo Lee", None), ("jo lee", "Jo LEE", "P1")], "clean string, raw string, person_id string")


# ---- stages

def _verified(s: SparkSession, _: str) -> DataFrame:
    rows = [(1, "own", ["a"], ["u"], "u", ["yes"]), (2, " ", ["a", "b"], ["u", "v"], "v", ["no", "no"]), (3, None, ["a", "b"], ["u", "v"], "w", ["no", "yes"]), (4, None, [" ", "b"], ["u", "v"], None, ["no", "no"]), (5, None, [], [], None, [])]
    df = s.createDataFrame(rows, "n int, own string, texts array<string>, urls array<string>, matched string, verdicts array<string>")
    return df.select("n", stages.verified_text(F.col("own"), F.col("texts"), F.col("urls"), F.col("matched"), F.col("verdicts")).alias("text"))


def _hosts(s: SparkSession, _: str) -> DataFrame:
    df = s.createDataFrame([(1, "https://en.a.org/x"), (2, "https://b.net"), (3, None)], "n int, url string")
    return df.select("n", stages.allowed_hosts(F.col("url"), ["a.org", "c.com"]).alias("allowed"))


def _overlapping(s: SparkSession, _: str) -> DataFrame:
    rows = [(1, 1, ["1900"], ["1901"]), (1, 2, ["1901", "1902"], ["1901"]), (1, 3, ["1901"], ["1901"]), (2, 1, [], ["1900"])]
    df = s.createDataFrame(rows, "k int, place int, years array<string>, wanted array<string>")
    return stages.first_overlapping(df, "k", "place", "years", "wanted").select("k", "place")


def _overlay(s: SparkSession, _: str) -> DataFrame:
    base = s.createDataFrame([(1, "a", " ", None), (2, None, "x", 5), (3, "c", None, 6)], "k int, p string, q string, r int")
    fresh = s.createDataFrame([(1, "z", "new", 7, "e1"), (2, "b", "y", 8, "e2")], "k int, p string, q string, r int, extra string")
    return stages.overlay(base, fresh, "k")


def _fetched(s: SparkSession, part: int) -> DataFrame:
    def fetch(i: int) -> tuple[int, str]:
        if i == 13:
            raise TimeoutError("slow")
        return (404, "gone") if i == 11 else (500, "e" * 300) if i == 12 else (200, f'{{"id": {i}}}')

    return stages.fetched(s, 10, 14, fetch, 2)[part]


def _asked(s: SparkSession, _: str) -> DataFrame:
    tried: dict[str, int] = {}

    def call(prompt: str) -> dict:
        tried[prompt] = tried.get(prompt, 0) + 1
        if "never" in prompt or "twice" in prompt and tried[prompt] < 2:
            raise ConnectionError("down")
        return {"text": prompt.upper(), "finish_reason": "stop"}

    backend = stages.with_retries(call, tries=3, sleep=lambda _: None)
    df = s.createDataFrame([(1, "a"), (2, "twice"), (3, "never")], "k int, p string")
    return stages.ask(df, F.col("p"), backend, 1, "k").select("k", "text", "finish_reason", "attempts", "error")


def _candidates(s: SparkSession, _: str) -> DataFrame:
    speakers = s.createDataFrame([(1, "Jo"), (2, "Al")], "k int, name string")
    links = s.createDataFrame([(1, 2, "u2"), (1, 1, "u1"), (1, 3, "u3")], "k int, place int, url string")
    pages = s.createDataFrame([("u1", "<p>One</p>")], "url string, html string")
    read = html.html_udf(lambda p: html.tree(p).text(" "), "string")
    out = stages.candidate_pages(speakers, "k", text.search_query(F.col("name")), links, pages, read("html"))
    return out.select("k", "search_query", _list("links").alias("links"), _list("texts").alias("texts"))


def _preloaded(s: SparkSession, _: str) -> DataFrame:
    df = s.createDataFrame([(1, '["a", "b"]', "x", "y"), (2, '["a"]', "x", "y"), (3, "[]", "x", "y"), (4, None, "x", None), (5, '["", ""]', "x", "y")], "n int, cell string, f string, g string")
    one, two = stages.text_columns(F.col("cell"), F.col("f"), F.col("g"))
    return df.select("n", one.alias("text_1"), two.alias("text_2"))


def _placed(s: SparkSession, _: str) -> DataFrame:
    rows = s.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ix int, v string")
    return stages.placed(rows, s.createDataFrame([(0, "r0", "?"), (2, "r2", "?")], "ix int, rec string, v string"), "ix")


def _members(s: SparkSession, _: str) -> DataFrame:
    rows = s.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, v string")
    return stages.members(rows, s.createDataFrame([(1, 1, "old"), (1, 2, "new"), (None, 3, "?")], "id int, at int, gender string"), "id", "at")


# ---- vectors and themes

def _embed(texts: list[str]) -> np.ndarray:
    return np.array([[float(len(t)), 1.0] for t in texts])


def _embedded(s: SparkSession, _: str) -> DataFrame:
    df = s.createDataFrame([(1, "abc"), (2, None)], "k int, t string")
    return stages.embedded(df, "k", "t", _embed, 1).select("k", F.round(F.col("vector")[0], 6).alias("x"), F.round(F.col("vector")[1], 6).alias("y"))


def _drifted(s: SparkSession, _: str) -> DataFrame:
    old = s.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "k int, vector array<double>")
    new = s.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "k int, vector array<double>")
    return stages.drifted(old, new, "k").withColumn("score", F.round("score", 6))


def _jaccards(s: SparkSession, _: str) -> DataFrame:
    kind = "array<array<double>>"
    rows = [(1, [[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]]), (2, [], []), (3, [[1.0, 0.0]], []), (4, [[1.0, 0.0], [0.8, 0.6]], [[0.8, 0.6], [1.0, 0.0]])]
    return s.createDataFrame(rows, f"n int, a {kind}, b {kind}").select("n", F.round(soft_jaccard()("a", "b"), 6).alias("j"))


def _agreement(s: SparkSession, _: str) -> DataFrame:
    vectors = s.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "theme string, vector array<double>")
    rows = [(1, ["a"]), (1, ["a"]), (1, ["a", "b"]), (2, ["a"]), (2, ["b"]), (3, ["a"]), (4, [])]
    return reports.theme_agreement(s.createDataFrame(rows, "speech_id long, themes array<string>"), vectors)


def _clusters(s: SparkSession, _: str) -> DataFrame:
    rows = [("x", "care", [1.0, 0.0], [1, 2]), ("x", "caring", [0.99, 0.14], [2, 3]), ("x", "rail", [0.0, 1.0], [4]), ("x", "rails", [0.1, 0.99], [4]), ("x", "war", [-1.0, 0.0], [5]), ("y", "one", [1.0, 0.0], [1])]
    return clusters.theme_clusters(s.createDataFrame(rows, "arm string, phrase string, vector array<double>, speech_ids array<long>")).select("arm", "cluster", "n_phrases", "n_speeches", "members")


def _chunks(s: SparkSession, _: str) -> DataFrame:
    df = s.createDataFrame([(1, "One two. Three four. Five six. Seven."), (2, ""), (3, "x" * 30), (4, None)], "k int, t string")
    return retrieval.chunk_rows(df, "k", "t", 20, 8)


# ---- evaluation

def _evaluated(s: SparkSession, _: str) -> DataFrame:
    rows = [(q, m, i, sc) for q in ("d1", "other") for m in ("whole", "chunk") for i, sc in ((1, 0.9), (2, 0.8 if m == "whole" else 0.1), (3, 0.2))]
    scores = s.createDataFrame(rows, "query_id string, mode string, speech_id long, score double")
    # Two definitions: d1 says yes for all, d2 for the first alone; a query is judged without its own.
    cell = lambda i, d, v, n: [(i, d, f"m{k}", v, "temp0", "json", True, False) for k in range(n)]
    panel = [c for i in (1, 2, 3) for c in cell(i, "d1", True, 2)] + cell(1, "d2", True, 3) + cell(2, "d2", False, 3) + cell(3, "d2", False, 3)
    df = s.createDataFrame(panel, "speech_id long, definition string, model_id string, mentions_topic boolean, condition string, output_format string, parse_ok boolean, presence_inferred boolean")
    queries = s.createDataFrame([("d1",), ("other",)], "query_id string")
    labels = metrics.queries_gold(df, df.limit(0), queries)
    return reports.ranked_results(metrics.evaluate_all(scores, labels))


def _fallback(s: SparkSession, _: str) -> DataFrame:
    pilot = s.createDataFrame([(1, "d1", True), (1, "d1", False), (2, "d1", False), (1, "d2", False), (2, "d2", True)], "speech_id long, definition string, mentions_topic boolean")
    queries = s.createDataFrame([("d2",), ("zz",)], "query_id string")
    return metrics.queries_gold(pilot.limit(0), pilot, queries)


def _spot(s: SparkSession, _: str) -> DataFrame:
    drawn = s.createDataFrame([(1, "top", 0.9), (2, "top", 0.8), (3, "bottom", 0.1), (4, "bottom", 0.2)], "speech_id long, band string, score double")
    cells = s.createDataFrame([(1, True), (1, False), (2, True), (3, False), (9, True)], "speech_id long, mentions_topic boolean")
    return reports.spotcheck(drawn, stages.arm(cells, mentions_topic=[True, False]))


def _plans(s: SparkSession, _: str) -> DataFrame:
    words = grids.Wording({"none": "", "expert": "You know it."}, {"v1": "Is {{TOPIC}} there?", "v2": "Has it {{TOPIC}}?", "v1_nocap": "List {{TOPIC}}."}, {"json": "JSON.", "free": ""}, {"current": "care", "d1": "health", "d2": "relief"}, "v1_nocap")
    speeches = s.createDataFrame([(i, 1900 + 10 * (i % 2)) for i in range(10)], "speech_id long, decade_bin int")
    models, model = s.createDataFrame([("m1",), ("m2",)], "model_id string"), s.createDataFrame([("m1",)], "model_id string")
    made = {
        "default": grids.default_plan(speeches, words, models, "current"), "default of 3": grids.default_plan(speeches, words, models, "current", n=3), "uncapped": grids.uncapped_plan(speeches, words, models, "current"),
        "role": grids.uncapped_plan(speeches, words, models, "current", role="expert"), "definitions": grids.definition_plan(speeches, words, models, ["d1", "d2"]),
        "panel": grids.panel_plan(speeches, words, model, ["d1", "d2"]), "determinism": grids.determinism_plan(speeches, words, model, "d1", 4),
    }
    out = None
    for name, plan in made.items():
        row = plan.cells().agg(F.count("*").alias("cells"), F.count_distinct("prompt_hash").alias("prompts"), F.count_distinct("speech_id").alias("speeches"), F.max("rep").alias("last_rep"), F.max("pool").alias("pool")).withColumn("plan", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES: dict[str, tuple[Query, str | None]] = {
    "jsn2_json_answers": _answers("json", _JSON),
    "jsn3_free_answers": _answers("free", _FREE),
    "jsn1_first_object": _cases(_python(answers.first_object, "string"), [('x {"a": "}\\"{"} y}', '{"a": "}\\"{"}'), ("none", None), ('{"a": {"b": 1}} {"c": 2}', '{"a": {"b": 1}}'), ("{open", None)]),
    "sto7_reparse": (_reparse, values({"speech_id": "BIGINT", "mentions_topic": "BOOLEAN", "themes": "INTEGER", "parse_ok": "BOOLEAN", "parse_error": "VARCHAR"}, [(1, True, 1, True, None), (2, None, 0, False, "timeout"), (3, True, 12, True, None), (4, True, 5, True, None), (5, None, 0, False, "no text")])),
    "ded5_themes": _cases(_python(lambda t: " / ".join(answers.clean_themes(t, 5)), "string"), [("  NHS funding ;nhs funding|None\nwaiting lists", "NHS funding / waiting lists"), ("a, b (c, d), e) f", "a / b (c, d), e) f"), ('"*quoted*". - x', "quoted*\". - x"), ("", ""), ("1;2;3;4;5;6", "1 / 2 / 3 / 4 / 5")]),
    "str9_presence": _cases(_python(lambda t: answers.Prose(t).presence(), "boolean"), [("Mentions topic: **No**\nyes", False), ("  yes, it does", True), ("not about it; covers it", False), ("discusses it, not about that", True), ("Nothing", None), ("Substantively relevant:\n\n true", True), ("notable", None)], "BOOLEAN"),
    "str10_items": _cases(_python(lambda t: " / ".join(answers.Prose(t).themes(9)), "string"), [("- a\n* b\n3) c\n4.d", "a / b / c"), ("Themes: rents, fees. More: x", "rents / fees"), ("It covers - fever; damp", "fever / damp"), ("no list", ""), ("-x\n-", "")]),
    "str1_split": _cases(lambda x: _list(text.plain_sentences(x)), _SENTENCES),
    "str3_pack": (_chunks, values({"k": "INTEGER", "chunk_ix": "INTEGER", "chunk": "VARCHAR"}, [(1, 0, "One two. Three four."), (1, 1, "Three four."), (1, 2, "Five six. Seven."), (3, 0, "x" * 20), (3, 1, "x" * 18)])),
    "str4_clean": _cases(names.clean_name, _CLEAN),
    "str5_sounds": _cases(names.block_key, _BLOCKS),
    "str6_ratio": (
        lambda s, _: s.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(_ALIKE)], "n int, a string, b string").select("n", F.round(names.name_similarity("a", "b"), 4).alias("y")),
        values({"n": "INTEGER", "y": "DOUBLE"}, [(i, y) for i, (*_, y) in enumerate(_ALIKE)]),
    ),
    "str8_fence": _cases(text.strip_fence, [("```json\n{}\n```", "{}"), (" x ", "x"), ("```\na", "a"), ("a ``` b", "a ``` b")]),
    "str12_genders": (_genders, values({"n": "INTEGER", "listed": "VARCHAR", "spelled": "VARCHAR"}, [(i, a, b) for i, (_, a, b) in enumerate(_SPEAKERS)])),
    "str14_date_ranges": _cases(lambda x: F.concat_ws(" | ", text.date_range(x)["content"], F.coalesce(text.date_range(x)["dates"], F.lit("null"))), _DATED),
    "str15_intro_years": _cases(text.intro_years, _INTRO, "INTEGER"),
    "str16_search_query": (_queries, values({"n": "INTEGER", "wide": "VARCHAR", "plain": "VARCHAR"}, [(1, "Jo Lee 1801 - 1850 J. Lee Lee Jo wikipedia", "Jo Lee 1801 - 1850 wikipedia"), (2, "Al wikipedia", "Al wikipedia")])),
    "str20_references": _cases(text.before_references, [("body\nReferences\nmore", "body\n"), ("no mark", "no mark"), ("References first", ""), ("a references b", "a references b")]),
    "str21_url_reply": _cases(lambda x: F.concat_ws(" | ", text.url_reply(x)["wikipedia"], text.url_reply(x)["wikidata"]), _REPLIES),
    "str22_parties": _cases(lambda x: names.canonical(x, {"Lab": "Labour", "None": None}), [("Lab", "Labour"), ("None", None), ("Whig", "Whig"), (None, None)]),
    "str25_iso": _cases(nested.dates_iso, [("1900-01-02T10:00:00", "1900-01-02"), ("1900-13-45 and more", "1900-13-45"), ("short", "short"), (None, None)]),
    "str26_verification": _cases(lambda x: text.render("Is {{NAME}} it?", name=x), [("Jo", "Is Jo it?"), (" ", "Is NA it?"), (None, "Is NA it?")]),
    "dt3_dates": _cases(text.whole_date, _DATES),
    "dt5_years": _cases(text.year_of, [("1999.0", 1999), ("1999.9", 1999), ("999", None), ("9999", None), ("x", None), (None, None)], "INTEGER"),
    "dt6_days": _cases(lambda x: text.day_or_null(x).cast("string"), [("1900-02-03", "1900-02-03"), ("1900-02-31", None), ("soon", None), (None, None)]),
    "jsn5_outer": _cases(text.outer_object, [('a {"b": {}} c', '{"b": {}}'), ("} {", "null"), ("{{}", "null"), ("none", "null")]),
    "jsn6_lists": _cases(lambda x: _list(text.string_list(x)), _LISTS),
    "prj4_cut": _cases(lambda x: text.truncated(x, 3), [("abcd", "abc"), ("ab", "ab"), (None, "")]),
    "prj5_filled": _cases(lambda x: text.first_filled(F.lit(" "), x, F.lit("last")), [("a", "a"), (" ", "last"), (None, "last")]),
    "prj6_deep_get": _cases(lambda x: text.deep_get(x, "a.b", "-"), [('{"a": {"b": "v"}}', "v"), ('{"a": 1}', "-"), ("", "-"), ('{"a": {"b": null}}', "-")]),
    "prj9_budget": _cases(lambda x: text.within_budget(F.lit("task"), x, 8), _BUDGETED),
    "prj11_templates": (_templates, values({"model": "VARCHAR", "query": "VARCHAR", "sent": "VARCHAR"}, [("a", "care of the sick", "query: care of the sick"), ("b", "Care", "Q Care!"), ("c", "Care", "Care")])),
    "prj13_backend": (_labels, values({"n": "INTEGER", "backend": "VARCHAR"}, [(1, "api.host.org"), (2, "unset"), (3, "own"), (4, "unknown")])),
    "flt10_day_years": _cases(lambda x: text.day_in_years(x, 1900, 1910), [("1900-01-01", True), ("1910-12-31", True), ("1911-01-01", False), ("x", None)], "BOOLEAN"),
    "dt1_analysis_eras": _cases(lambda x: eras.era_of(x, eras.ANALYSIS_ERAS), [("1899", "pre-1900"), ("1900", "1900-1947"), ("1947", "1900-1947"), ("1948", "post-1948"), ("2025", "post-1948"), (None, None), ("n.d.", None), ("2101", None)]),
    "clu2_people": (
        _people,
        values(
            {"person_id": "VARCHAR", "canonical_name": "VARCHAR", "aliases": "VARCHAR", "first": "VARCHAR", "last": "VARCHAR", "gap_days": "INTEGER", "n_variants": "BIGINT", "n_rows": "BIGINT"},
            [("P00001", "ann ox", "ann ox", None, None, None, 1, 1), ("P00002", "jane jones", "jane jones; jane jons", "1890-01-01", "1891-01-01", 365, 2, 2), ("P00003", "john smith", "john smith", "1900-01-01", "1901-01-01", 365, 1, 2), ("P00004", "smith john", "smith john", "1902-05-05", "1902-05-05", 0, 1, 1), ("P00005", "john smyth", "john smyth", "1950-01-01", "1950-01-01", 0, 1, 1)],
        ),
    ),
    "src10_index": _pages(lambda p: _flat(html.section_index(p, "http://h/d/")), [_INDEX, ""], [["0|Army|http://h/a|c1|90 words", "1|Pay|http://h/d/b|None|None", "0|Navy|http://x/c|c2|None"]]),
    "src11_contributions": _pages(lambda p: ["failed"] if html.missing_page(p) else ["|".join(c) for c in html.contributions(p, "http://h")], [_SECTION, "<h1>Page not\nfound</h1>", "<p>Alone.</p>"], [["Mr. X|http://h/people/x|One.\nTwo.", "Mr. Y||Three."], ["failed"], ["||Alone."]]),
    "src12_debates": _pages(lambda p: _told(html.debate_tree(p, "http://h")), [_DAY, "<p></p>"], [["0|Care|item|Rose.", "0|Care|Jo — Ox|http://h/m/1|One. Two.", "1|Fees|UNKNOWN|None|Three."]]),
    "src13_calendar": _pages(html.business_dates, [_CALENDAR], [["1980-03-03", "1980-03-04"]]),
    "src14_downloads": _pages(lambda p: html.download_links(p, "http://h"), [_MENU], [["http://h/d/1.html"]]),
    "src15_speaker": _pages(_card, [_CARD, "<p>x</p>"], [["Mr. Jo Lee|1801 - 1850", "constituencies|Ox|March 3, 1820 - May 4, 1830", "titles_in_lords|Baron Ox|July 1, 1840", "titles_in_lords|Peer|None", "notes|Seen|June 2, 1841 –"], ["no page"]]),
    "src15_index": _pages(lambda p: ["|".join(x) for x in html.speaker_index(p, "http://h/people/l")], [_LETTER], [["Mr. Jo Lee|1801 - 1850|http://h/people/mr-lee", "Ox||http://h/people/mr-ox"]]),
    "src16_articles": _pages(lambda p: [html.article_text(p), html.article_text(p, "sorted"), html.article_text(p, "compact"), html.article_intro(p)], [_ARTICLE], [[
        "Main text:\n\nJo Lee was.\n\nBorn 1801 Died\n\nLife\n\nOne\n\nInfobox:\n\nBorn: 1801", "Main text:\n\nJo Lee was.\n\nLife\n\nOne\n\nBorn 1801 Died\n\nInfobox:\n\nBorn: 1801",
        "JoLeewas.\n\nMain text:\nJo Lee was.\nLife\nOne\n\nInfobox:\nBorn: 1801\nDied:", "JoLeewas.",
    ]]),
    "src17_linked": _pages(lambda p: [html.linked_data(p)], ['<script type="application/ld+json"> {"a": 1} </script><p>x</p>', "<p>One</p><p>Two</p>"], [['{"a": 1}'], ["One\nTwo"]]),
    "src7_transcripts": (
        lambda s, _: nested.transcript_rows(s.createDataFrame([(x,) for x in _TRANSCRIPTS], "value string")),
        values({"date": "VARCHAR", "title": "VARCHAR", "speaker": "VARCHAR", "speaker_url": "VARCHAR", "speech": "VARCHAR"}, [("1900-01-01", "A", "x", None, "1"), ("1900-01-01", "B", "y", "/y", "2"), ("1900-01-01", "C", "z", None, "")]),
    ),
    "src9_members": (
        lambda s, _: nested.member_core(nested.member_records(s.createDataFrame([(f % _MEMBER,) for f in ("[%s]", '[{"value": %s}]', '{"items": [{"value": %s}]}', '{"value": %s}', "%s")] + [('{"id": 8}',)], "j string"), "j")),
        values({"member_id": "BIGINT", "name": "VARCHAR", "party": "VARCHAR", "seat": "VARCHAR"}, [(7, "Jo", "W", "House of Lords")] * 5),
    ),
    "jsn7_parties": (
        lambda s, _: nested.party_rows(*_bios(s), {"Lab": "Labour", "None": None}),
        values({"name": "VARCHAR", "party": "VARCHAR", "start_year": "INTEGER", "end_year": "INTEGER"}, [(n, p, y, None) for n in ("Mr. Jo Lee", "Jo LEE", "j. lee") for p, y in (("Labour", 1990), (None, 1995))]),
    ),
    "jsn7_constituencies": (
        lambda s, _: nested.constituency_rows(*_bios(s)),
        values({"name": "VARCHAR", "seat": "VARCHAR", "start": "VARCHAR", '"end"': "VARCHAR"}, [(n, *r) for n in ("Mr. Jo Lee", "Jo LEE", "j. lee") for r in (("Ox", "1990-01-01", "1995-01-01"), (None, "", ""))]),
    ),
    "jsn7_education": (
        lambda s, _: nested.education_rows(*_bios(s), years=True),
        values(
            {"name": "VARCHAR", "level": "VARCHAR", "institution": "VARCHAR", "type": "VARCHAR", "country": "VARCHAR", "degree": "VARCHAR", "field": "VARCHAR", "start_year": "INTEGER", "end_year": "INTEGER"},
            [(n, *r) for n in ("Mr. Jo Lee", "Jo LEE", "j. lee") for r in (("school", "Ox School", None, None, None, None, None, None), ("university", "Ox", None, None, None, None, None, None), ("university", "Cam", None, None, "BA", None, 1980, None))],
        ),
    ),
    "join15_bios": (
        lambda s, _: nested.bio_rows(*_bios(s)).select("name", "name_from_transcript", "date_of_birth", "first_elected", "ministerial_positions"),
        values({"name": "VARCHAR", "name_from_transcript": "VARCHAR", "date_of_birth": "VARCHAR", "first_elected": "VARCHAR", "ministerial_positions": "VARCHAR"}, [("Jo L.", n, "1950-06-01", "1990-01-01", "A; B") for n in ("Mr. Jo Lee", "Jo LEE", "j. lee")]),
    ),
    "speakers_extract": (
        lambda s, _: speakers.unlinked(nested.transcript_rows(s.createDataFrame([(x,) for x in _TRANSCRIPTS], "value string"))),
        values({"date": "VARCHAR", "title": "VARCHAR", "speaker": "VARCHAR", "speaker_clean": "VARCHAR"}, [("1900-01-01", "A", "x", "x"), ("1900-01-01", "C", "z", "z")]),
    ),
    "speakers_report": (
        lambda s, _: speakers.report(
            speakers.identified(s.createDataFrame([("a",), ("a",), ("b",), ("c",)], "speaker_clean string"), s.createDataFrame([("P1", "a", "a; aa"), ("P2", "bb", "b; bb")], "person_id string, canonical_name string, aliases string")),
            s.createDataFrame([("P1",), ("P9",), (None,)], "person_id string"),
        ),
        values({"rows": "BIGINT", "with_bio": "BIGINT", "people": "BIGINT", "people_with_bio": "BIGINT"}, [(4, 2, 2, 1)]),
    ),
    "prj7_verified": (_verified, values({"n": "INTEGER", "text": "VARCHAR"}, [(1, "own"), (2, "b"), (3, "b"), (4, "b"), (5, None)])),
    "prj8_fill": (_overlay, values({"k": "INTEGER", "p": "VARCHAR", "q": "VARCHAR", "r": "INTEGER", "extra": "VARCHAR"}, [(1, "a", "new", 7, "e1"), (2, "b", "x", 5, "e2"), (3, "c", None, 6, None)])),
    "flt11_hosts": (_hosts, values({"n": "INTEGER", "allowed": "BOOLEAN"}, [(1, True), (2, False), (3, None)])),
    "join14_overlap": (_overlapping, values({"k": "INTEGER", "place": "INTEGER"}, [(1, 2)])),
    "join13_places": (_placed, values({"ix": "INTEGER", "v": "VARCHAR", "rec": "VARCHAR"}, [(0, "a", "r0"), (1, "b", None), (2, "c", "r2")])),
    "join17_members": (_members, values({"id": "INTEGER", "v": "VARCHAR", "gender": "VARCHAR"}, [(1, "x", "new"), (2, "y", None), (None, "z", None)])),
    "src18_records": (lambda s, _: _fetched(s, 0), values({"id": "BIGINT", "body": "VARCHAR"}, [(10, '{"id": 10}'), (14, '{"id": 14}')])),
    "src18_failed": (lambda s, _: _fetched(s, 1), values({"id": "BIGINT", "status": "INTEGER", "note": "VARCHAR"}, [(11, 404, "Not found"), (12, 500, "e" * 200), (13, None, "TimeoutError: slow")])),
    "src20_retries": (_asked, values({"k": "INTEGER", "text": "VARCHAR", "finish_reason": "VARCHAR", "attempts": "INTEGER", "error": "VARCHAR"}, [(1, "A", "stop", 1, None), (2, "TWICE", "stop", 2, None), (3, None, None, 3, "ConnectionError: down")])),
    "src21_candidates": (_candidates, values({"k": "INTEGER", "search_query": "VARCHAR", "links": "VARCHAR", "texts": "VARCHAR"}, [(1, "Jo wikipedia", "u1 / u2", "One / "), (2, "Al wikipedia", "", "")])),
    "src22_preloaded": (_preloaded, values({"n": "INTEGER", "text_1": "VARCHAR", "text_2": "VARCHAR"}, [(1, "a", "b"), (2, "a", ""), (3, "x", "y"), (4, "x", None), (5, "x", "y")])),
    "vec1_embedded": (_embedded, values({"k": "INTEGER", "x": "DOUBLE", "y": "DOUBLE"}, [(1, 0.948683, 0.316228), (2, 0.0, 1.0)])),
    "vec2_normalised": (
        lambda s, _: s.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "n int, v array<double>").select("n", normalised(F.col("v")).alias("u")).select("n", F.round(F.col("u")[0], 6).alias("x"), F.round(F.col("u")[1], 6).alias("y")),
        values({"n": "INTEGER", "x": "DOUBLE", "y": "DOUBLE"}, [(1, 0.6, 0.8), (2, 0.0, 0.0)]),
    ),
    "vec9_drifted": (_drifted, values({"k": "INTEGER", "score": "DOUBLE"}, [(2, 0.6)])),
    "vec10_jaccard": (_jaccards, values({"n": "INTEGER", "j": "DOUBLE"}, [(1, 0.5), (2, 1.0), (3, 0.0), (4, 1.0)])),
    "met12_agreement": (_agreement, values({"speech_id": "BIGINT", "agreement": "DOUBLE", "pairs": "BIGINT"}, [(1, 0.666667, 3), (2, 0.0, 1)])),
    "clu1_small": (_clusters, values({"arm": "VARCHAR", "cluster": "INTEGER", "n_phrases": "BIGINT", "n_speeches": "BIGINT", "members": "VARCHAR"}, [("x", 0, 2, 3, "care; caring"), ("x", 1, 2, 1, "rail; rails")])),
    "met20_evaluate": (_evaluated, values({"query_id": "VARCHAR", "mode": "VARCHAR", "auroc": "DOUBLE", "ap": "DOUBLE", "positives": "BIGINT", "negatives": "BIGINT", "rank": "BIGINT"}, [("d1", "chunk", 1.0, 1.0, 1, 2, 1), ("d1", "whole", 1.0, 1.0, 1, 2, 2), ("other", "chunk", 1.0, 1.0, 1, 2, 3), ("other", "whole", 1.0, 1.0, 1, 2, 4)])),
    "met13_fallback": (_fallback, values({"query_id": "VARCHAR", "speech_id": "BIGINT", "label": "INTEGER"}, [("d2", 1, 0), ("d2", 2, 1), ("zz", 1, 1), ("zz", 2, 0)])),
    "met21_spotcheck": (_spot, values({"band": "VARCHAR", "n_speeches": "BIGINT", "n_labelled": "BIGINT", "rate": "DOUBLE", "mean_score": "DOUBLE"}, [("top", 2, 2, 0.75, 0.85), ("bottom", 2, 1, 0.0, 0.15)])),
    "sto2_plans": (
        _plans,
        values(
            {"plan": "VARCHAR", "cells": "BIGINT", "prompts": "BIGINT", "speeches": "BIGINT", "last_rep": "INTEGER", "pool": "VARCHAR"},
            [("default", 160, 8, 10, 0, "pilot"), ("default of 3", 48, 8, 3, 0, "pilot"), ("uncapped", 40, 2, 10, 0, "pilot"), ("role", 40, 2, 10, 0, "pilot"), ("definitions", 80, 4, 10, 0, "pilot"), ("panel", 40, 2, 10, 0, "eval2k"), ("determinism", 12, 1, 4, 2, "eval2k")],
        ),
    ),
}
