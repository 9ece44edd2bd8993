"""Speaker names: cleaning, blocking, similarity and titles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VERBS = "asked|said|replied|continued|added"
HONORIFICS = "mr|mrs|ms|miss|lord|lady|sir|dr|colonel|general|captain|major|earl|viscount|baron|baroness|duke|archbishop"
MALE = ("mr", "sir", "lord", "baron", "viscount", "duke", "earl", "marquess")
FEMALE = ("mrs", "ms", "miss", "lady", "dame", "duchess", "countess", "baroness", "viscountess")
# Offices that say nothing about who holds them.
OFFICES = ("speaker", "chairman", "chair", "president", "secretary", "treasurer", "minister", "advocate", "attorney", "solicitor", "chancellor", "archbishop", "bishop")
# Ranks, titles and styles, as patterns, that stand before a name.
RANKS = (
    r"Lieut[\-\s]?Colonel", r"Lt[\-\s]?Col", "Major", "Colonel", r"Brigadier(?:[\-\s]?General)?", r"Lieut[\-\s]?Commander", r"Lieutenant[\-\s]?Commander", "Lieutenant",
    "Captain", "Commander", "Commodore", r"Wing[\-\s]?Commander", r"Group[\-\s]?Captain", r"Air[\-\s]?Commodore", r"Rear[\-\s]?Admiral", r"Vice[\-\s]?Admiral", "Admiral",
    r"Field[\-\s]?Marshal", r"Major[\-\s]?General", r"Lieut[\-\s]?General", "General", r"Air[\-\s]?Vice[\-\s]?Marshall", r"Squadron[\-\s]?Leader", r"Flight[\-\s]?Lieut", r"Sub[\-\s]?Lieutenant",
    "Viscountess", "Viscount", "Baroness", "Baron", "Lord", "Lady", "Earl", "Countess", "Marquess", "Marchioness", "Duke", "Duchess",
    "Hon(?:orable)?", "Sir", "Dame", "Dr", "Professor", "Prof", "Reverend", "Rev", r"Master(?:[\s\-]of[\s\w]+)?", "Count", r"The\sO'Conor\sDon", r"The\sO'Donoghue[^\s]*", r"Of\b",
)


def clean_name(name: Column) -> Column:
    """Name in lower case without a trailing verb, one honorific, an article and edges that are no letters."""
    n = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), rf"(?i)\s+({VERBS})$", "")
    n = F.regexp_replace(n, rf"(?i)^({HONORIFICS})\.?,?\s+", "")
    n = F.lower(F.regexp_replace(n, r"(?i)^(the|a|an)\s+", ""))
    n = F.regexp_replace(n, r"^[^a-z\s-]+|[^a-z\s-]+$", "")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def block_key(name: Column) -> Column:
    """First letter and the sound of the last word; empty for an empty name."""
    last = F.element_at(F.split(name, " "), -1)
    return F.when(F.length(name) > 0, F.concat(F.left(name, F.lit(1)), F.lit("-"), F.soundex(last))).otherwise("")


def indel_ratio(a: str, b: str) -> float:
    """Similarity 0 to 100 from the longest common subsequence."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two names as sets of words: common words against each side's rest, the best of the three pairings."""
    x, y = {*a.split()}, {*b.split()}
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(sorted(s)) for s in (x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [indel_ratio(one, two)]
    if both:
        scores += [indel_ratio(both, one), indel_ratio(both, two)]
    return max(scores)


def name_similarity(a: str, b: str) -> Column:
    """`token_set_ratio` of two columns, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(F.col(a), F.col(b))


def title_gender(name: Column) -> Column:
    """Gender that a title anywhere in the name tells, else null."""
    word = F.lower(F.regexp_extract(name, rf"(?i)\b({'|'.join(sorted({*MALE, *FEMALE}, key=len, reverse=True))})\b", 1))
    return F.when(word.isin(*MALE), "male").when(word.isin(*FEMALE), "female")


def leading_gender(name: Column) -> Column:
    """Gender that the first word tells if it is a title, else null."""
    word = F.regexp_replace(F.lower(F.try_element_at(F.split(F.trim(name), r"\s+"), F.lit(1))), r"[.,]+$", "")
    return F.when(word.isin(*MALE), "male").when(word.isin(*FEMALE), "female")


def without_ranks(name: Column, ranks: Sequence[str] = RANKS, times: int = 3) -> Column:
    """Name without the titles, ranks and offices it begins with, at most ``times`` of them."""
    pattern = rf"(?i)^(?:{'|'.join(ranks)})\s+"
    for _ in range(times):
        name = F.trim(F.regexp_replace(name, pattern, ""))
    return name


def _given_table(given: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in given.items() for x in pair)) if given else F.create_map().cast("map<string,string>")


def first_word_gender(name: Column, given: Mapping[str, str], likely: bool = False) -> Column:
    """Gender of the first word by a dictionary of given names, a table that the user brings.

    The dictionary says male or female, or mostly_male or mostly_female, which count only if ``likely``.
    """
    word = F.lower(F.regexp_extract(name, r"^\W*(\w+)", 1))
    said = _given_table(given)[word]
    return F.when(said.isin("male", "female"), said).when(F.lit(likely) & said.startswith("mostly_"), F.regexp_replace(said, "^mostly_", ""))


def speaker_gender(name: Column, given: Mapping[str, str], override: Mapping[str, str]) -> Column:
    """Gender of a listed speaker in stages, each for what the earlier ones left open: the leading title, the leading title
    behind ranks, the given name behind ranks, an exact override."""
    stripped = without_ranks(name)
    return F.coalesce(leading_gender(name), leading_gender(stripped), first_word_gender(stripped, given), _given_table(override)[name])


def spelling_gender(name: Column, given: Mapping[str, str]) -> Column:
    """Gender of a spelling in a transcript: a title anywhere, else null for an office, else the given name behind ranks,
    of which likely ones count."""
    cleaned = F.regexp_replace(clean_name(name), "^the ", "")
    office = F.try_element_at(F.split(cleaned, " "), F.lit(1)).isin(*OFFICES)
    return F.coalesce(title_gender(cleaned), F.when(~office & (cleaned != ""), first_word_gender(without_ranks(cleaned, times=1), given, True)))


def canonical(value: Column, names: Mapping[str, str | None]) -> Column:
    """Canonical spelling by a map: what the map lacks passes through, what it maps to None becomes null."""
    keys = F.lit(list(names)) if names else F.array().cast("array<string>")
    table = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v).cast("string")))) if names else F.create_map().cast("map<string,string>")
    return F.when(F.array_contains(keys, value), table[value]).otherwise(value)
