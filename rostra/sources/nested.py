"""Nested documents: transcripts of any depth, member records in several envelopes, and biographies."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions.names import canonical
from rostra.functions.text import first_filled, whole_date, year_of
from rostra.runtime import map_rows


def _speeches(line: str) -> Iterator[tuple]:
    try:
        day = json.loads(line)
    except ValueError:
        return
    if not isinstance(day, dict):
        return
    chambers = (day.get("data") or {}).get("chambers") or {}
    # A stack of entries in reverse, so that they come out in the order of the transcript.
    open_ = [e for entries in reversed(list(chambers.values())) for e in reversed(entries or [])]
    while open_:
        entry = open_.pop()
        for said in entry.get("content") or []:
            yield (day.get("day"), entry.get("title") or "", said.get("speaker"), said.get("speaker_url"), said.get("text") or said.get("speech") or "")
        open_.extend(reversed(entry.get("subsections") or []))


def transcript_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Speeches (date, title, speaker, speaker_url, speech) of day records, one JSON object a line, nested to any depth.

    Lines that are no JSON object give no rows.
    """
    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (line,) in rows:
            if line and line.strip():
                yield from _speeches(line)

    return map_rows(lines.select(column), walk, "date string, title string, speaker string, speaker_url string, speech string")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Speeches of transcript files."""
    return transcript_rows(spark.read.text(path))


def member_records(payload: DataFrame, column: str) -> DataFrame:
    """Member objects of payloads that are a list, a list of ``value`` wrappers, an object with ``items``, or one object."""
    whole = F.try_parse_json(column)
    listed = F.coalesce(F.try_variant_get(whole, "$.items", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"), F.array(whole))
    one = F.explode(listed).alias("v")
    inner = F.coalesce(F.try_variant_get("v", "$.value", "variant"), F.col("v"))
    return payload.select(one).select(inner.alias("member")).filter("member is not null")


def member_core(members: DataFrame) -> DataFrame:
    """Core of member objects (member_id, name, party, seat); members without a name drop out."""
    get = lambda p: F.try_variant_get("member", p, "string")
    return members.select(
        get("$.id").try_cast("long").alias("member_id"), first_filled(get("$.nameDisplayAs"), get("$.nameListAs")).alias("name"),
        F.coalesce(first_filled(get("$.latestParty.name"), get("$.latestParty.abbreviation")), F.lit("")).alias("party"),
        F.coalesce(first_filled(get("$.latestHouseMembership.membershipFrom")), F.lit("House of Lords")).alias("seat"),
    ).filter("name is not null")


AFFILIATIONS = "party_affiliation array<struct<party:string,start_year:string,end_year:string>>"
BIOGRAPHY = (
    "name string, date_of_birth string, date_of_death string, place_of_birth string, occupation_before_politics string, "
    "political_career struct<first_elected:string,last_elected:string,ministerial_positions:array<string>,leadership_positions:array<string>>"
)
CONSTITUENCIES = "constituencies array<struct<seat:string,start:string,end:string>>"
EDUCATION = "education struct<school_name:string,school_type:string,school_country:string,universities:array<string>>"


def _people(bios: DataFrame, spellings: DataFrame, schema: str, own: str = "raw") -> DataFrame:
    """Biographies under every spelling of their person's name: (name, bio), the bio parsed by ``schema``.

    ``bios`` has person_id, canonical_name, aliases and bio (JSON); ``spellings`` has clean and raw names, and person_id
    where a transcript row is known to be theirs, whose ``own`` name in small letters is one of the person's names too. A
    clean name without a raw spelling stands for itself.
    """
    known = F.array_distinct(F.filter(F.transform(F.split(F.concat_ws(";", "canonical_name", "aliases"), ";"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    # A broken text is read as an object of nulls, which is none.
    whole = bios.filter(F.try_variant_get(F.try_parse_json("bio"), "$", "map<string,variant>").isNotNull())
    held = whole.select("person_id", known.alias("names"), F.from_json("bio", schema).alias("bio")).filter("bio is not null")
    named = held.select(F.explode("names").alias("clean"), "person_id")
    if "person_id" in spellings.columns:
        named = named.unionByName(spellings.filter("person_id is not null").select(F.lower(own).alias("clean"), "person_id"))
    raw = spellings.select("clean", "raw").distinct()
    names = named.distinct().join(raw, "clean", "left").select("person_id", F.coalesce("raw", "clean").alias("name"))
    return names.join(held.select("person_id", "bio"), "person_id").select("name", "bio")


def bio_rows(bios: DataFrame, spellings: DataFrame) -> DataFrame:
    """Biographies under every spelling of their person's name, one for a spelling: (name, name_from_transcript, dates of birth
    and death, place_of_birth, occupation_before_politics, first_elected, last_elected, ministerial_positions, leadership_positions).

    A biography without a name takes the spelling; of several biographies for a spelling the first in their order holds.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ")
    career = "bio.political_career."
    rows = _people(bios, spellings, BIOGRAPHY, "clean").select(
        first_filled(F.col("bio.name"), F.col("name")).alias("name"), F.col("name").alias("name_from_transcript"), whole_date(text("bio.date_of_birth")).alias("date_of_birth"),
        whole_date(text("bio.date_of_death")).alias("date_of_death"), F.col("bio.place_of_birth").alias("place_of_birth"), F.col("bio.occupation_before_politics").alias("occupation_before_politics"),
        whole_date(text(career + "first_elected")).alias("first_elected"), whole_date(text(career + "last_elected")).alias("last_elected"),
        joined(career + "ministerial_positions").alias("ministerial_positions"), joined(career + "leadership_positions").alias("leadership_positions"),
    )
    others = [c for c in rows.columns if c != "name_from_transcript"]
    one = rows.groupBy("name_from_transcript").agg(F.min(F.struct(*others)).alias("r"))
    return one.select("r.name", "name_from_transcript", *(f"r.{c}" for c in others[1:]))


def party_rows(bios: DataFrame, spellings: DataFrame, parties: Mapping[str, str | None]) -> DataFrame:
    """Affiliations of people under every spelling of their name: (name, party, start_year, end_year), each once."""
    people = _people(bios, spellings, AFFILIATIONS).select("name", F.explode("bio.party_affiliation").alias("a")).filter(F.trim("a.party") != "")
    return people.select("name", canonical(F.trim("a.party"), parties).alias("party"), year_of(F.col("a.start_year")).alias("start_year"), year_of(F.col("a.end_year")).alias("end_year")).distinct()


def constituency_rows(bios: DataFrame, spellings: DataFrame) -> DataFrame:
    """Seats of people under every spelling of their name: (name, seat, start, end), each once; a blank seat is null."""
    people = _people(bios, spellings, CONSTITUENCIES).select("name", F.explode("bio.constituencies").alias("c")).filter("c is not null")
    day = lambda c: whole_date(F.coalesce(F.col(c), F.lit("")))
    return people.select("name", F.nullif(F.trim("c.seat"), F.lit("")).alias("seat"), day("c.start").alias("start"), day("c.end").alias("end")).distinct()


def education_rows(bios: DataFrame, spellings: DataFrame, years: bool = False) -> DataFrame:
    """Schools and universities of people under every spelling of their name: (name, level, institution, type, country,
    degree, field), with years if asked for, each once.

    A university is a name or an object, whose fields have two spellings.
    """
    people = _people(bios, spellings, EDUCATION).select("name", F.col("bio.education").alias("e"))
    filled = lambda *cols: F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))
    none = F.lit(None).cast("string")
    school = F.when(
        filled(F.col("e.school_name"), F.col("e.school_type"), F.col("e.school_country")).isNotNull(),
        F.array(F.struct(F.lit("school").alias("level"), filled(F.col("e.school_name")).alias("institution"), filled(F.col("e.school_type")).alias("type"), filled(F.col("e.school_country")).alias("country"), none.alias("degree"), none.alias("field"), none.alias("start_year"), none.alias("end_year"))),
    )

    def university(u: Column) -> Column:
        # A name comes as it stands, an object as its text.
        get = lambda k: F.when(F.trim(u).startswith("{"), F.get_json_object(u, f"$.{k}"))
        bare = F.when(~F.trim(u).startswith("{"), F.trim(u))
        return F.struct(
            F.lit("university").alias("level"), F.coalesce(bare, filled(get("university_name"), get("name"))).alias("institution"), filled(get("university_type"), get("type")).alias("type"),
            filled(get("university_country"), get("country")).alias("country"), filled(get("degree_level"), get("degree")).alias("degree"), filled(get("field_of_study"), get("subject")).alias("field"),
            get("start_year").alias("start_year"), get("end_year").alias("end_year"),
        )

    empty = F.array().cast("array<string>")
    rows = F.concat(F.coalesce(school, F.transform(empty, university)), F.transform(F.filter(F.coalesce(F.col("e.universities"), empty), lambda u: u.isNotNull()), university))
    out = people.select("name", F.explode(rows).alias("r")).select("name", "r.*")
    if not years:
        return out.drop("start_year", "end_year").distinct()
    return out.withColumns({c: year_of(F.col(c)) for c in ("start_year", "end_year")}).distinct()


def dates_iso(column: Column) -> Column:
    """ISO date text of a timestamp, else the first ten characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(column), "yyyy-MM-dd"), F.left(column, F.lit(10)))
