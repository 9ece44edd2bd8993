import random

import pytest

from rostra.llm import pairs

JSON_TASK = "Decide whether the speech below mentions health and care. Reply in JSON with mentions_topic, subthemes and explanation."
FREE_TASK = "You are a careful reader. State yes or no for health and care, name each theme on its own line, then give a short reason."
PASSAGE = "In 1829 some 272 spinners depended upon the sanitary board of the town so that the surveyors could restore their account."
DDL = "call_id long, prompt_text string, text string, finish_reason string, error string, raw string"

SEEDED = [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("```json\n```", "empty"), ('""', "empty"), ("{}", "empty"),
    ('{"mentions_topic": true, "subthemes": ["school meals", "fever hos', "truncated"), ("Yes.\n- school meals\nMost of the passage turns on sch", "truncated"), ("Yes.\n- school meals\n- fever hos", "truncated"),
    ("No. Nothing beyond the canals and th ", "truncated"), ("I'm sorry, but I can't help with that request.", "refusal"), ("As a language tool I am unable to judge speeches.", "refusal"),
    ("Request declined: the passage might contain sensitive medical information.", "refusal"), (PASSAGE, "copy"), (FREE_TASK, "copy"), (PASSAGE.replace("some ", "").upper(), "copy"),
    ('{"mentions_topic": false, "subthemes": [], "explanation": "Почему палата сократила отчёт ревизоров в третий раз."}', "language"),
    ("Nein. Warum änderte der Ausschuss das Grundbuch zum dritten Mal und ohne jede Aussprache?", "language"), ("是.\n- school meals\n港务局不顾许多抱怨延长了港口的预算。", "language"),
    ("No.", None), ("No. I cannot see any mention of health; the speaker only wants to suspend the statute.", None), ("No: Sorry, little to report: the board printed a vote and the speaker agrees.", None),
    ("Yes.\n- school meals\n- fever hospitals", None), ('{"mentions_topic": false, "subthemes": []}', None), ("Yes:\nThe speaker quotes a paper, “Warum prüfte der Ausschuss das Grundbuch ohne jede Aussprache?”, and then leaves it aside.\n- school meals", None),
]


def table():
    """The seeded answers among many sound ones, as defects are rare."""
    rng = random.Random(1)
    themes = ["school meals", "fever hospitals", "drug pricing"]
    rows = []
    for i in range(600):
        t = rng.sample(themes, 2)
        text = rng.choice([f"Yes.\n- {t[0]}\n- {t[1]}\nMost of the passage turns on {t[0]} and on who should pay.", "No. The passage is about the harbour and not about care.", f'{{"mentions_topic": true, "subthemes": ["{t[0]}"], "explanation": "Mention is made of {t[0]}."}}'])
        rows.append((1000 + i, f"{FREE_TASK}\n\n{PASSAGE}", text, rng.choice(["stop", "stop", "stop", None, "length"]), None, "?"))
    for i, (text, _) in enumerate(SEEDED * 2):
        rows.append((i, f"{JSON_TASK if text and text.startswith('{') else FREE_TASK}\n\n{PASSAGE}", text, "stop", None, "?"))
    return rows


def test_seeded_pairs(spark, clash):
    rows = table()
    df = clash(spark.createDataFrame(rows + rows[:30] + [(5000, None, None, None, "timeout", None), (5001, None, "Yes.", None, None, None)], DDL))
    got = {r["call_id"]: r["defect"] for r in pairs.found(df).collect()}
    want = {i: d for i, (_, d) in enumerate(SEEDED * 2) if d} | {5000: "empty"}
    assert got == want
    several = pairs.defects(df).groupBy("call_id").count().filter("count > 1").count()
    assert several > 0


def test_empty_table_and_long_answer(spark):
    assert pairs.found(spark.createDataFrame([], DDL)).count() == 0
    long = "Yes. " + "The speaker links the harbour to the board of the town. " * 20_000
    assert pairs.found(spark.createDataFrame([(1, FREE_TASK, long, None, None, None)], DDL)).count() == 0


@pytest.mark.parametrize("text,lang", [("the speaker only wants to leave it", "en"), ("le projet de pont et la taxe", "fr"), ("der Ausschuss und das Grundbuch", "de"), ("el consejo y los informes", "es"), ("yn ôl yr arolygydd a'r bwrdd", "cy"), ("Почему палата", "cyrillic"), ("123", None)])
def test_language(text, lang):
    assert pairs.language(text) == lang


def test_the_model_is_the_same_at_every_size():
    known = {((1, 0), True): 300, ((1, 1), True): 300, ((-1, 0), False): 900, ((-1, 1), False): 15, ((1, 0), False): 10}
    table = {(-1, 0): 9500, (-1, 1): 150, (1, 0): 200, (1, 1): 150}
    one = pairs.fit(table, known)
    for times in (0.01, 1000):
        other = pairs.fit({p: n * times for p, n in table.items()}, known)
        assert all(abs(one[p] - other[p]) < 1e-6 for p in one)
    assert one[1, 0] > 0.9 and one[-1, 1] < 0.1
    assert pairs.cutoff(one, {((1, 0), True): 50, ((-1, 0), False): 50}) == 0.5
