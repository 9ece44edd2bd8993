"""The speaker pipeline: from transcripts to people and tables about them, as functions and as verbs of a command line.

    python -m rostra.speakers all --transcripts DIR --work DIR --backend package.module:function

Tables lie in the work folder under the names of their stages, as Parquet; a stage whose table is there is not run again,
but for research, which asks for what is still missing.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable, Mapping

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions import names
from rostra.operators import clusters, stages
from rostra.runtime import checkpointed, shared_file
from rostra.sources import nested

VERBS = ("extract", "cluster", "research", "bios", "parties", "constituencies", "education", "gender", "report", "all")


def unlinked(rows: DataFrame) -> DataFrame:
    """Speeches whose speaker has a name but no page: (date, title, speaker, speaker_clean)."""
    clean = names.clean_name(F.col("speaker"))
    named = rows.filter(F.trim(F.coalesce("speaker_url", F.lit(""))) == "").select("date", F.coalesce("title", F.lit("")).alias("title"), "speaker", clean.alias("speaker_clean"))
    return named.filter("speaker <> '' and speaker_clean <> ''")


def identified(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Rows with the person_id of the person who has their name among the aliases."""
    alias = F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.transform(F.split("aliases", ";"), lambda x: F.trim(x)))))
    known = people.select(alias.alias("speaker_clean"), "person_id").filter("speaker_clean <> ''").distinct()
    return rows.drop("person_id").join(known, "speaker_clean", "left")


def profile() -> Column:
    """What a person is looked up by: names and the days of the first and last speech, as JSON."""
    day = lambda c: F.coalesce(nested.dates_iso(F.col(c).cast("string")), F.lit(""))
    aliases = F.transform(F.split("aliases", ";"), lambda x: F.trim(x))
    return F.to_json(F.struct("canonical_name", aliases.alias("aliases"), day("first").alias("first_speech"), day("last").alias("last_speech")))


def researched(people: DataFrame, known: DataFrame | None, backend: Callable[[str], Mapping], tasks: int = 16) -> DataFrame:
    """People with a biography in JSON: (person_id, canonical_name, aliases, bio), asked for where ``known`` has none.

    ``backend`` gets a profile and must not raise (see `stages.with_retries`); an answer with an error is an empty biography.
    """
    have = people.sparkSession.createDataFrame([], "person_id string, bio string") if known is None else known.filter("trim(bio) <> ''").select("person_id", "bio")
    todo = stages.resumed(people, have, "person_id")
    said = checkpointed(stages.ask(todo, profile(), backend, tasks, "person_id").select("person_id", F.coalesce(F.trim("text"), F.lit("")).alias("bio")))
    return people.select("person_id", "canonical_name", "aliases").join(have.unionByName(said), "person_id")


def spellings(rows: DataFrame) -> DataFrame:
    """Spellings of the transcript with their clean name: (clean, raw, person_id)."""
    return rows.select(F.col("speaker_clean").alias("clean"), F.col("speaker").alias("raw"), "person_id").distinct()


def genders(rows: DataFrame, given: Mapping[str, str]) -> DataFrame:
    """Gender of every spelling: (name, gender)."""
    return rows.select(F.col("speaker").alias("name")).filter("trim(name) <> ''").distinct().withColumn("gender", names.spelling_gender(F.col("name"), given))


def report(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """How much of the transcript has a biography: (rows, with_bio, people, people_with_bio)."""
    have = meta.select("person_id", F.lit(True).alias("_has")).filter("person_id is not null").distinct()
    seen = rows.join(have, "person_id", "left")
    return seen.agg(F.count("*").alias("rows"), F.count("_has").alias("with_bio"), F.count_distinct("person_id").alias("people"), F.count_distinct(F.when(F.col("_has"), F.col("person_id"))).alias("people_with_bio"))


class Pipeline:
    """The stages over a work folder; ``options`` has transcripts, work, backend, parties and given names."""

    def __init__(self, spark: SparkSession, options: argparse.Namespace):
        self.spark, self.options = spark, options

    def have(self, name: str) -> bool:
        """Is the table of a stage there?"""
        system, path = shared_file(self.spark, f"{self.options.work}/{name}/_SUCCESS")
        return bool(system.exists(path))

    def read(self, name: str) -> DataFrame:
        """The table of a stage, which is run if it is not there."""
        if not self.have(name):
            getattr(self, name)()
        return self.spark.read.parquet(f"{self.options.work}/{name}")

    def write(self, name: str, df: DataFrame) -> None:
        """Write the table of a stage."""
        df.write.mode("overwrite").parquet(f"{self.options.work}/{name}")

    def table(self, path: str | None) -> dict:
        """A small map from a JSON file, which the user brings."""
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())) if path else {}

    def extract(self) -> None:
        """Speeches without a speaker's page."""
        self.write("extract", unlinked(nested.read_transcripts(self.spark, self.options.transcripts)))

    def cluster(self) -> None:
        """People behind the spellings."""
        self.write("cluster", clusters.speakers(self.read("extract").select("speaker", "date")))

    def rows(self) -> DataFrame:
        """Speeches with their person."""
        return identified(self.read("extract"), self.read("cluster"))

    def research(self) -> None:
        """Biographies of people, by the backend; those there are stay."""
        module, _, name = (self.options.backend or "").partition(":")
        if not name:
            raise SystemExit("research needs --backend package.module:function")
        home = importlib.import_module(module)
        # Workers may not have the module on their path: it is sent along.
        cloudpickle.register_pickle_by_value(home)
        backend = stages.with_retries(getattr(home, name))
        known = checkpointed(self.spark.read.parquet(f"{self.options.work}/research")) if self.have("research") else None
        self.write("research", researched(self.read("cluster"), known, backend))

    def bios(self) -> None:
        """Biographies by spelling."""
        self.write("bios", nested.bio_rows(self.read("research"), spellings(self.rows())))

    def parties(self) -> None:
        """Party memberships by spelling."""
        self.write("parties", nested.party_rows(self.read("research"), spellings(self.rows()), self.table(self.options.parties)))

    def constituencies(self) -> None:
        """Seats by spelling."""
        self.write("constituencies", nested.constituency_rows(self.read("research"), spellings(self.rows())))

    def education(self) -> None:
        """Schools and universities by spelling."""
        self.write("education", nested.education_rows(self.read("research"), spellings(self.rows())))

    def gender(self) -> None:
        """Gender by spelling."""
        self.write("gender", genders(self.rows(), self.table(self.options.given)))

    def report(self) -> None:
        """Coverage, printed as one line."""
        print(json.dumps(report(self.rows(), self.read("research")).first().asDict()))

    def all(self) -> None:
        """Every stage in turn."""
        for verb in VERBS[:-1]:
            if verb not in ("extract", "cluster") or not self.have(verb):
                getattr(self, verb)()


def main(words: list[str] | None = None) -> None:
    """Run one verb."""
    parser = argparse.ArgumentParser(prog="rostra.speakers", description=__doc__)
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("--transcripts", help="transcript files, a JSON object a line")
    parser.add_argument("--work", required=True, help="folder of the stages' tables")
    parser.add_argument("--backend", help="package.module:function that answers a profile with a mapping that has text")
    parser.add_argument("--parties", help="JSON file that maps names of parties to canonical ones or null")
    parser.add_argument("--given", help="JSON file that maps given names in small letters to a gender")
    options = parser.parse_args(words)
    getattr(Pipeline(SparkSession.builder.getOrCreate(), options), options.verb)()


if __name__ == "__main__":
    main()
