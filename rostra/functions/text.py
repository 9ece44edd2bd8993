"""Scalar functions over text, dates and loosely typed values."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The seed vocabulary that stratifies samples, in three groups, applied to lower-cased text.
SEED_MODERN = (
    r"social care|care home|domiciliary care|residential care|adult social care|care worker|carer|\bnhs\b|national health service|public health|mental health|health care|healthcare"
)
SEED_HISTORICAL = (
    r"poor law|workhouse|\bpauper|board of guardians|relieving officer|district nurs|lunatic asylum|feeble.minded|mental deficiency|friendly society|\binfirmary\b|almshouse"
    r"|sanitar|board of health|fever hospital|\bvaccination\b|\bsmallpox\b|\bcholera\b|\btuberculosis\b|medical officer of health|\bdispensary\b"
)
SEED_EPIDEMIC = (
    r"\bcovid\b|\bcoronavirus\b|\bpandemic\b|long covid|\blockdown\b|\bfurlough\b|\bepidemic\b|\binfluenza\b|spanish flu|\bquarantine\b|\boutbreak\b"
    r"|\btyphoid\b|\btyphus\b|\bdiphtheria\b|scarlet fever|\bplague\b"
)
SEED = "|".join((SEED_MODERN, SEED_HISTORICAL, SEED_EPIDEMIC))
# What never ends a sentence although it has a full stop.
TITLED = "Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Hon|Rt|Gen|Col|Capt|Sgt|Lt|Maj|St|vs|etc|viz|cf|Jr|Sr|Ltd|Co|Inc|Cl|vol|vols|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
DOTTED = ("e.g", "i.e", "u.s", "u.k", "u.n", "m.p", "p.m")
CHUNK, OVERLAP = 400, 80


def seed_present(text: Column, seed: str = SEED) -> Column:
    """Does the text hold a word of the seed vocabulary, an alternation of patterns over lower-cased text?

    A term of letters, blanks, dots, hyphens and word bounds is looked for by its longest literal, as a byte search is
    several times as fast as an alternation; its pattern is tried only where the literal stands.
    """
    if not all(re.fullmatch(r"(?:\\b|[\w .\-])+", t) for t in seed.split("|")):
        return F.lower(text).rlike(seed)

    def holds(low: Column) -> Column:
        hits = []
        for term in seed.split("|"):
            literal = max(term.replace(r"\b", "").split("."), key=len)
            hits.append(low.contains(literal) if literal == term else low.contains(literal) & low.rlike(term))
        return reduce(lambda a, b: a | b, hits)

    # The variable of a lambda is worked out once; in a chain of alternatives the lower case would be made for each.
    return F.exists(F.array(F.lower(text)), holds)


def plain_sentences(text: Column) -> Column:
    """Sentences by masked full stops, natively: titles, dotted abbreviations, initials, numbers and decimals never end one."""
    joiner = "⁠"
    masked = F.regexp_replace(text, rf"(?i)\b({TITLED})\.", rf"$1{joiner}")
    # Of a dotted form, the inner stop before its second letter and the outer one behind it.
    inner = "|".join(rf"(?<=\b{a})\.(?={b}\.)|(?<=\b{a}\.{b})\." for a, b in (form.split(".") for form in DOTTED))
    masked = F.regexp_replace(masked, f"(?i){inner}", joiner)
    masked = F.regexp_replace(masked, r"\b([A-Z])\.(?=\s*[A-Z])", rf"$1{joiner}")
    masked = F.regexp_replace(masked, r"(?i)\b(Nos?)\.(?=\s*\d)", rf"$1{joiner}")
    masked = F.regexp_replace(masked, r"(?<=\d)\.(?=\d)", joiner)
    parts = F.transform(F.split(masked, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(F.regexp_replace(x, joiner, ".")))
    return F.filter(parts, lambda x: x != "")


def hard_windows(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Sliding windows over a text; a text within the size is one window."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def pack_units(units: list[str], size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks of whole units up to ``size`` characters; the next chunk takes up about ``overlap`` characters again."""
    lengths = [len(u) for u in units]
    chunks, first = [], 0
    while first < len(units):
        stop, width = first + 1, lengths[first]
        while width < size and stop < len(units) and width + 1 + lengths[stop] <= size:
            width += 1 + lengths[stop]
            stop += 1
        chunks.append(" ".join(units[first:stop]))
        if stop == len(units):
            break
        back, shared = stop, -1
        while back > first + 1 and shared < overlap:
            back -= 1
            shared += 1 + lengths[back]
        first = back
    return chunks


def chunk_units(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Sentences of a text, those beyond the size cut into windows: what chunks are packed from."""
    return F.flatten(F.transform(plain_sentences(F.trim(F.coalesce(text, F.lit("")))), lambda s: hard_windows(s, size, overlap)))


def content_hash(text: Column) -> Column:
    """Twelve hexadecimal digits that stand for a text in keys."""
    return F.left(F.sha1(F.encode(text, "UTF-8")), F.lit(12))


def cell_key(speech: Column, prompt: Column, model: Column, temperature: Column, seed: Column, rep: Column) -> Column:
    """Text key of a grid cell: parts joined by bars, a missing part as None."""
    return F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("None")) for c in (speech, prompt, model, temperature, seed, rep))), "|")


def strip_fence(text: Column) -> Column:
    """Text without a code fence around it."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")).otherwise(t)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def truthy(value: Column) -> Column:
    """Boolean of the words true, yes, y, 1 and false, no, n, 0; null for anything else."""
    word = F.lower(F.trim(value))
    return F.when(word.isin("true", "yes", "y", "1"), True).when(word.isin("false", "no", "n", "0"), False)


def reply_word(reply: Column) -> Column:
    """A strict yes, no or uncertain."""
    word = F.lower(F.trim(reply))
    return F.when(word.isin("yes", "no"), word).otherwise("uncertain")


def quoted_span(text: Column) -> Column:
    """First quoted span of 8 to 400 characters, in double or else in single quotes; empty if there is none."""
    spans = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r'"([^"]{8,400})"', r"'([^']{8,400})'")]
    return F.coalesce(*spans, F.lit(""))


def outer_object(text: Column) -> Column:
    """From the first brace to the last, if as many open as close; else the word null."""
    start, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.substring(text, start, end - start + 1)
    count = lambda c: F.length(inner) - F.length(F.replace(inner, F.lit(c), F.lit("")))
    return F.when((start > 0) & (F.instr(text, "}") > 0) & (end >= start) & (count("{") == count("}")), inner).otherwise("null")


def _literal_list(cell: str | None) -> list[str | None] | None:
    try:
        found = ast.literal_eval(cell) if isinstance(cell, str) else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return [None if x is None else str(x) for x in found] if isinstance(found, list) else None


def string_list(cell: Column) -> Column:
    """List of strings from a list in a cell, in JSON or, as older tables have it, as a Python literal; empty if it is none."""

    @F.pandas_udf("array<string>")
    def literals(cells: pd.Series) -> pd.Series:
        return cells.map(_literal_list)

    json = F.from_json(cell, "array<string>")
    literal = F.when(json.isNull() & F.trim(cell).startswith("["), cell)
    return F.coalesce(json, literals(literal), F.array().cast("array<string>"))


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters of a text; nothing for null."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(most))


def deep_get(cell: Column, path: str, default: str | None = None) -> Column:
    """Value at a path of a JSON text, ``default`` where the text or a step of the path is missing."""
    found = F.get_json_object(cell, "$." + path)
    return found if default is None else F.coalesce(found, F.lit(default))


def years_in(text: Column) -> Column:
    """Distinct years 1000 to 2099 that a text names, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_])(1\d{3}|20\d{2})(?![0-9A-Za-z_])"), F.lit(1)))


def intro_years(text: Column) -> Column:
    """Number of distinct years 1600 to 2099 in the first paragraph behind the mark of the main text, or in a text without it."""
    body = F.try_element_at(F.split(text, "Main text:", 2), F.lit(2))
    part = F.when(text.contains("Main text:"), F.coalesce(F.try_element_at(F.filter(F.split(body, "\n\n"), lambda p: F.trim(F.translate(p, "\n\t", "  ")) != ""), F.lit(1)), body)).otherwise(text)
    return F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(part, F.lit("")), F.lit(r"(?<![0-9A-Za-z_])(1[6-9]\d{2}|20\d{2})(?![0-9A-Za-z_])"), F.lit(1))))


def date_range(text: Column) -> Column:
    """Text and the dates it ends with, as a struct (content, dates): a day, a span of days or one without an end; dates null where there are none."""
    day = r"[A-Za-z]+\s+\d{1,2},\s*\d{4}"
    pattern = rf"(?s)^(.+?)\s+({day}(?:\s*[-–]\s*(?:{day})?)?)$"
    dates = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    return F.struct(F.when(dates.isNotNull(), F.regexp_extract(text, pattern, 1)).otherwise(text).alias("content"), dates.alias("dates"))


def search_query(*parts: Column, lists: Sequence[Column] = (), last: str = "wikipedia") -> Column:
    """Words for a search engine: the parts that are filled, the entries of lists without what stands in brackets, a last word."""
    entries = [F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([^)]*\)", ""), "[;,]"), lambda x: F.trim(x)), lambda x: x != "") for c in lists]
    given = F.filter(F.array(*parts), lambda x: F.trim(x) != "")
    return F.array_join(F.concat(given, *entries, F.array(F.lit(last))), " ")


def query_text(description: Column, name: Column) -> Column:
    """What a query is embedded from: its description, or its name where that is blank."""
    return F.coalesce(F.nullif(F.trim(description), F.lit("")), name)


def templated(text: Column, templates: Mapping[str, str], model: Column) -> Column:
    """Text in the template of its model, which holds ``{text}``; a model without one takes it bare."""
    table = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair)) if templates else F.create_map().cast("map<string,string>")
    return F.replace(F.coalesce(table[model], F.lit("{text}")), F.lit("{text}"), text)


def backend_label(url: Column, override: Column | None = None) -> Column:
    """Which stack served a row: the label that was set, else the host of its address; unset without an address."""
    host = F.when(url.isNull(), "unset").otherwise(F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("unknown")))
    return host if override is None else F.coalesce(F.nullif(override, F.lit("")), host)


def day_in_years(day: Column, first: int, last: int) -> Column:
    """Does the year that an ISO day begins with lie in a range, both ends included?"""
    return F.left(day, F.lit(4)).try_cast("int").between(first, last)


def url_reply(reply: Column) -> Column:
    """Links of a reply of labelled lines, as a struct (wikipedia, wikidata); "Not found" for a missing line."""
    def link(label: str) -> Column:
        line = F.try_element_at(F.filter(F.transform(F.split(reply, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: F.lower(x).startswith(label) & x.contains(":")), F.lit(-1))
        return F.coalesce(F.trim(F.regexp_replace(line, r"^[^:]*:", "")), F.lit("Not found"))

    return F.struct(link("wikipedia url").alias("wikipedia"), link("wikidata url").alias("wikidata"))


def before_references(text: Column) -> Column:
    """Text before a line that starts the references."""
    return F.element_at(F.split(text, r"(?im)^\s*references\b", 2), 1)


def labelled_line(text: Column, label: str) -> Column:
    """Value after ``label:`` at the start of a line."""
    return F.trim(F.regexp_extract(text, rf"(?im)^\s*{label}\s*:\s*(.*)$", 1))


def within_budget(prompt: Column, text: Column, budget: int) -> Column:
    """The text if it fits the budget together with the prompt, else what stands before its references, null if that is too long as well."""
    fits = lambda t: F.greatest(F.lit(1), F.floor(F.length(F.concat(prompt, F.lit("\n"), t)) / 4)) <= budget
    short = before_references(text)
    return F.when(fits(text), text).when(fits(short), short)


def token_budget(text: Column, budget: int) -> Column:
    """Does a text, at four characters a token, stay within the budget?"""
    return F.floor(F.length(text) / 4) <= budget


def whole_date(text: Column) -> Column:
    """ISO date of a full or partial date: months and days that are missing or zero become the first; else empty."""
    t = F.trim(text)
    t = F.regexp_replace(F.regexp_replace(t, r"^(\d{4})-00-00$", "$1-01-01"), r"^(\d{4}-\d{2})-00$", "$1-01")
    year = F.when(t.rlike(r"^\d{4}$") & (t >= "1000") & (t.try_cast("int") <= F.year(F.current_date())), F.concat(t, F.lit("-01-01")))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d+$"), F.coalesce(year, F.lit(""))).otherwise(
        F.coalesce(F.date_format(F.try_to_timestamp(t, F.lit("d MMMM yyyy")), "yyyy-MM-dd"), F.date_format(F.try_to_timestamp(t), "yyyy-MM-dd"), F.lit(""))
    )


def year_of(text: Column, low: int = 1000, high: int | None = None) -> Column:
    """Whole year of a value in a range, which ends five years from now if not told otherwise; else null."""
    year = F.floor(text.try_cast("double")).cast("int")
    return F.when(year.between(F.lit(low), F.lit(high) if high is not None else F.year(F.current_date()) + 5), year)


def day_or_null(text: Column) -> Column:
    """Date of a text, null for what is none."""
    return F.try_to_date(text)


def service_span(start: Column, end: Column) -> Column:
    """Years of two dates as text."""
    return F.concat(F.left(start, F.lit(4)), F.lit(" to "), F.coalesce(F.left(end, F.lit(4)), F.lit("present")))


def profile_text(fields: dict[str, Column]) -> Column:
    """Lines of label and value for the fields that are filled."""
    return F.concat_ws("\n", *(F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in fields.items()))


def render(template: str, **values: Column) -> Column:
    """A template with ``{{NAME}}`` replaced by columns; a null or blank value reads NA."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name.upper() + "}}"), F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("NA")))
    return out
