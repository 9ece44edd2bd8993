"""Plans of an annotation grid: prompt variants as a small table, and their rendering. Wording comes from the user."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions.text import content_hash
from rostra.operators.store import jobs
from rostra.operators.strata import systematic

PLACE = "{{SPEECH}}"


def variants(spark: SparkSession, roles: Mapping[str, str], tasks: Mapping[str, str], formats: Mapping[str, str], definitions: Mapping[str, str]) -> DataFrame:
    """Product of roles, tasks, formats and definitions, by name and wording, with its template and hash.

    A task's wording may hold ``{{TOPIC}}``, which the definition fills. An empty role has no system part.
    """
    dim = lambda name, table: spark.createDataFrame(list(table.items()), f"{name} string, {name}_text string").coalesce(1)
    grid = dim("role", roles).crossJoin(dim("task", tasks)).crossJoin(dim("output_format", formats)).crossJoin(dim("definition", definitions))
    task = F.replace(F.col("task_text"), F.lit("{{TOPIC}}"), F.col("definition_text"))
    user = F.concat_ws("\n\n", F.nullif(task, F.lit("")), F.nullif(F.col("output_format_text"), F.lit("")), F.lit(f"Speech:\n{PLACE}"))
    template = F.when(F.col("role_text") != "", F.concat(F.lit("[system]\n"), F.col("role_text"), F.lit("\n\n[user]\n"), user)).otherwise(F.concat(F.lit("[user]\n"), user))
    return grid.select(
        F.concat(F.lit("role="), "role", F.lit("|task="), "task", F.lit("|format="), "output_format").alias("variant_id"), "role", "task", "output_format", "definition",
        F.col("role_text").alias("system"), user.alias("user"), content_hash(template).alias("prompt_hash"),
    )


def rendered(user: Column, speech: Column) -> Column:
    """The user message of a variant for a speech."""
    return F.replace(user, F.lit(PLACE), speech)


def conditions(spark: SparkSession, rows: Sequence[tuple[str, float, int | None, int]]) -> DataFrame:
    """Sampling conditions: name, temperature, seed, repetitions."""
    return spark.createDataFrame(list(rows), "condition string, temperature double, seed long, reps int").coalesce(1)


#: Named conditions of a grid: name, temperature, seed, repetitions.
CORE, STOCHASTIC, AGAIN, REPEATED = ("temp0", 0.0, 42, 1), ("temp07", 0.7, None, 1), ("temp07", 0.7, None, 3), ("temp0rep", 0.0, 42, 3)


@dataclass(frozen=True)
class Wording:
    """What prompts are made of, by name: roles, tasks, formats and definitions; ``free`` is the task without a cap."""

    roles: Mapping[str, str]
    tasks: Mapping[str, str]
    formats: Mapping[str, str]
    definitions: Mapping[str, str]
    free: str

    def some(self, roles: Sequence[str], tasks: Sequence[str], formats: Sequence[str], definitions: Sequence[str]) -> Wording:
        """The wording with some of each part."""
        pick = lambda table, names: {n: table[n] for n in names}
        return replace(self, roles=pick(self.roles, roles), tasks=pick(self.tasks, tasks), formats=pick(self.formats, formats), definitions=pick(self.definitions, definitions))

    def variants(self, spark: SparkSession) -> DataFrame:
        """All prompts of the wording."""
        return variants(spark, self.roles, self.tasks, self.formats, self.definitions)

    def capped(self) -> list[str]:
        """Tasks that ask for a number of themes at most."""
        return [t for t in self.tasks if t != self.free]


@dataclass(frozen=True)
class Plan:
    """What is to be run: speeches, prompts, models and conditions; ``cells`` are its jobs less those done."""

    speeches: DataFrame
    variants: DataFrame
    models: DataFrame
    conditions: DataFrame
    pool: str = "pilot"

    def cells(self, done: DataFrame | None = None) -> DataFrame:
        """One row for each job, with the pool it belongs to."""
        return jobs(self.speeches, self.variants, self.models, self.conditions, done).withColumn("pool", F.lit(self.pool))


def first_speeches(speeches: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first speeches of a sample for a trial, in the order of their keys."""
    return speeches if n is None else speeches.orderBy(key).limit(n)


def _plan(speeches: DataFrame, words: Wording, models: DataFrame, named: Sequence[tuple], n: int | None, pool: str) -> Plan:
    spark = speeches.sparkSession
    return Plan(first_speeches(speeches, "speech_id", n), words.variants(spark), models, conditions(spark, named), pool)


def default_plan(speeches: DataFrame, words: Wording, models: DataFrame, current: str, named: Sequence[tuple] = (CORE,), n: int | None = None) -> Plan:
    """The whole grid of roles, capped tasks and formats under the current definition."""
    return _plan(speeches, words.some(list(words.roles), words.capped(), list(words.formats), [current]), models, named, n, "pilot")


def uncapped_plan(speeches: DataFrame, words: Wording, models: DataFrame, current: str, role: str = "none", named: Sequence[tuple] = (CORE,), n: int | None = None) -> Plan:
    """The task without a cap under one role in all formats; with another role than none, the role's own arm."""
    return _plan(speeches, words.some([role], [words.free], list(words.formats), [current]), models, named, n, "pilot")


def definition_plan(speeches: DataFrame, words: Wording, models: DataFrame, definitions: Sequence[str], named: Sequence[tuple] = (CORE,), n: int | None = None) -> Plan:
    """Several definitions under the task without a cap, no role, in all formats."""
    return _plan(speeches, words.some(["none"], [words.free], list(words.formats), definitions), models, named, n, "pilot")


def panel_plan(speeches: DataFrame, words: Wording, model: DataFrame, definitions: Sequence[str]) -> Plan:
    """One model on a whole evaluation sample: several definitions in JSON, once firmly and once freely."""
    return _plan(speeches, words.some(["none"], [words.free], ["json"], definitions), model, (CORE, STOCHASTIC), None, "eval2k")


def determinism_plan(speeches: DataFrame, words: Wording, model: DataFrame, definition: str, n: int = 200) -> Plan:
    """One model asked the same three times about a systematic part of a sample (speech_id, decade_bin)."""
    return _plan(systematic(speeches, ["decade_bin", "speech_id"], n), words.some(["none"], [words.free], ["json"], [definition]), model, (REPEATED,), None, "eval2k")
