import random

import pytest
from pyspark.sql import functions as F

from rostra.functions import answers, names, text
from rostra.functions.eras import ANALYSIS_ERAS, SAMPLING_ERAS, era_of
from rostra.functions.vectors import soft_jaccard


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def x():
    return F.col("x")


@pytest.mark.parametrize("year,name", [("1899", "pre-1900"), ("1900", "1900-1947"), ("1947", "1900-1947"), ("1948", "post-1948"), ("2025", "post-1948"), (None, None), ("n.d.", None), ("2101", None)])
def test_analysis_eras(spark, year, name):
    assert one(spark, era_of(x(), ANALYSIS_ERAS), year) == name


def test_sampling_eras_differ(spark):
    assert one(spark, era_of(x(), SAMPLING_ERAS), "1946") == "1945_1980"


def test_seed_terms_and_pattern_agree(spark):
    rng = random.Random(1)
    words = [w.replace(r"\b", "") for w in text.SEED.split("|")] + ["x", "nhss", "paupers", "unvaccination", "feeble-minded", "care", "social"]
    rows = [(rng.choice(["", "un", " "]).join((w := rng.choice(words))[: rng.choice([3, 30, 30])].title() + rng.choice([" ", "", "s "]) for _ in range(2)),) for _ in range(1500)]
    got = spark.createDataFrame([*rows, (None,)], "x string").select("x", text.seed_present(x()).alias("a"), F.lower("x").rlike(text.SEED).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and 300 < sum(bool(r["a"]) for r in got) < 1500


def test_plain_sentences(spark):
    said = "Mr. A. B. Smith, e.g. of No. 3, paid 3.5 pounds. He said no. Then we left!\nNew line"
    assert one(spark, text.plain_sentences(x()), said) == ["Mr. A. B. Smith, e.g. of No. 3, paid 3.5 pounds.", "He said no.", "Then we left!", "New line"]


def test_chunks_lose_nothing(spark):
    units = [f"sentence {i} " + "w" * (i * 7 % 90) for i in range(60)]
    chunks = text.pack_units(units)
    assert all(len(c) <= text.CHUNK for c in chunks)
    assert all(any(u in c for c in chunks) for u in units)
    assert text.pack_units([]) == [] and text.pack_units(["a" * 400, "b"]) == ["a" * 400, "b"]


def test_windows(spark):
    got = one(spark, text.hard_windows(x()), "z" * 1000)
    assert [len(w) for w in got] == [400, 400, 360] and one(spark, text.hard_windows(x()), "short") == ["short"]


@pytest.mark.parametrize("raw,iso", [("1901", "1901-01-01"), ("1901-05", "1901-05-01"), ("1901-00-00", "1901-01-01"), ("1901-07-00", "1901-07-01"), ("3 March 1920", "1920-03-03"), ("?", ""), ("0999", "")])
def test_whole_date(spark, raw, iso):
    assert one(spark, text.whole_date(x()), raw) == iso


def test_small_scalars(spark):
    assert one(spark, text.truthy(x()), " Yes ") is True and one(spark, text.truthy(x()), "0") is False and one(spark, text.truthy(x()), "maybe") is None
    assert one(spark, text.reply_word(x()), "YES") == "yes" and one(spark, text.reply_word(x()), "Yes, it is") == "uncertain"
    assert one(spark, text.strip_fence(x()), "```json\n{}\n```") == "{}"
    assert one(spark, text.outer_object(x()), 'a {"b": {}} c') == '{"b": {}}' and one(spark, text.outer_object(x()), "} {") == "null"
    assert one(spark, text.first_filled(F.lit(" "), x()), "b") == "b"
    assert one(spark, text.year_of(x()), "1999.0") == 1999 and one(spark, text.year_of(x()), "999") is None
    assert one(spark, text.before_references(x()), "body\nReferences\nmore").strip() == "body"
    assert one(spark, text.labelled_line(x(), "url"), "Answer: yes\nURL: http://a\n") == "http://a"
    assert one(spark, text.render("a {{NAME}} b", name=x()), None) == "a NA b"
    key = text.cell_key(F.lit(1), F.lit("h"), F.lit("m"), F.lit(0.0), F.lit(None), F.lit(0))
    assert one(spark, key, "") == "1|h|m|0.0|None|0"
    assert one(spark, text.service_span(x(), F.lit(None).cast("string")), "1999-01-02") == "1999 to present"


def test_names(spark):
    assert one(spark, names.clean_name(x()), "Mr. John  Smith said") == "john smith"
    assert one(spark, names.clean_name(x()), "The Lord Advocate") == "lord advocate"
    assert one(spark, names.clean_name(x()), None) == ""
    assert one(spark, names.block_key(x()), "john smith") == "j-S530" and one(spark, names.block_key(x()), "") == ""
    assert names.token_set_ratio("john smith", "smith john") == 100 and names.token_set_ratio("a", "") == 0
    assert names.token_set_ratio("mary ann jones", "mary jones") == 100 and names.token_set_ratio("abc", "xyz") == 0
    assert one(spark, names.title_gender(x()), "the duchess of x") == "female" and one(spark, names.title_gender(x()), "j smith") is None
    assert one(spark, names.speaker_gender(x(), {"ann": "female"}, {"q": "male"}), "Dr Ann Lee") == "female"
    assert one(spark, names.speaker_gender(x(), {"ann": "female"}, {"q": "male"}), "q") == "male"
    table = {"Lab": "Labour", "None": None}
    assert [one(spark, names.canonical(x(), table), v) for v in ("Lab", "None", "Whig")] == ["Labour", None, "Whig"]


def test_answers():
    ok = answers.parse_json('{"mentions_topic": "Yes", "subthemes": ["A", "a ", "none", "b"], "evidence_quote": "q"}', 5)
    assert ok == (True, ["A", "b"], "q", True, None, False, ["A", "b"])
    fenced = answers.parse_json('Here:\n```json\n{"mentions_topic": false, "subthemes": ["x"]}\n```', 5)
    assert fenced[0] is False and fenced[1] == [] and fenced[6] == ["x"]
    assert answers.parse_json("prose only", 5)[4] == "no JSON object found" and answers.parse_json(" ", 5)[4] == "empty response"
    assert answers.parse_json('{"a": }', 5)[4].startswith("json decode") and answers.parse_json('{"a": 1}', 5)[4].startswith("missing")
    assert answers.first_object('x {"a": "}\\"{"} y}') == '{"a": "}\\"{"}'
    assert len(answers.clean_themes([str(i) for i in range(12)], 5)) == 5 and answers.clean_themes("a, b (c, d); e", 9) == ["a", "b (c, d)", "e"]
    yes = answers.parse_free("Yes.\n- one\n* two\nBecause \"a quoted passage\".", 5)
    assert yes[:3] == (True, ["one", "two"], "a quoted passage")
    inferred = answers.parse_free("1. one\n2) two", 5)
    assert inferred[0] is True and inferred[5] is True
    assert answers.parse_free("The speech does not discuss it.", 5)[0] is False
    assert answers.parse_free("Mentions topic: **No**\n- a", 5)[0] is False
    assert answers.parse_free("Nothing here", 5)[4] == "no yes/no signal in free text"
    with pytest.raises(ValueError):
        answers.parse("x", "xml", 5)


def test_soft_jaccard(spark):
    kind = "array<array<double>>"
    df = spark.createDataFrame([([[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]]), ([], []), ([[1.0, 0.0]], [])], f"a {kind}, b {kind}")
    assert [r[0] for r in df.select(soft_jaccard()("a", "b")).collect()] == [0.5, 1.0, 0.0]
