import pytest

from rostra.llm import sentences as module
from rostra.llm.sentences import ABBR, TITLE, corpus_facts, sentence_spans, sentences

CASES = [
    ("The rate stood at 3.1 per cent. of it. B. N. Oxton of St. Wex's spoke.", ["The rate stood at 3.1 per cent. of it.", "B. N. Oxton of St. Wex's spoke."]),
    ("It began at 12.49 a.m.  A deputation came.", ["It began at 12.49 a.m.", "A deputation came."]),
    ("He said no. The return of Schedule No. 3 shows 5 in the U.K. alone.", ["He said no.", "The return of Schedule No. 3 shows 5 in the U.K. alone."]),
    ("It was … how shall I put it … a bargain! We waited ... and waited.", ["It was … how shall I put it … a bargain!", "We waited ... and waited."]),
    ("Did he cry “Shame! Who will?” when it came? 'We shall not. We cannot,' said he.", ["Did he cry “Shame! Who will?” when it came?", "'We shall not. We cannot,' said he."]),
    ("He replied, “It is so.” Then (Laughter.) [Hon. Members: \"Oh!\"] We left.", ["He replied, “It is so.”", "Then (Laughter.)", "[Hon. Members: \"Oh!\"]", "We left."]),
    ("Heading one\nText. (Laughter.) More.", ["Heading one", "Text.", "(Laughter.)", "More."]),
    ("議会は「待てない。今日採決する。」と述べた。なぜか！", ["議会は「待てない。今日採決する。」と述べた。", "なぜか！"]),
    ("सभा ने पढ़ा, कुल 72982.5 पाउंड। डॉ. Ingul आए।", ["सभा ने पढ़ा, कुल 72982.5 पाउंड।", "डॉ. Ingul आए।"]),
    ("لماذا درس؟ قال د. Olm إن الوزير درس.", ["لماذا درس؟", "قال د. Olm إن الوزير درس."]),
    ("Γιατί το 1941; Ο κ. Oxl είπε.", ["Γιατί το 1941;", "Ο κ. Oxl είπε."]),
    ("One; two. Three", ["One; two.", "Three"]),
    ("คณะกรรมการลดภาษี เหรัญญิกปี1906 ที่ประชุม", ["คณะกรรมการลดภาษี", "เหรัญญิกปี1906", "ที่ประชุม"]),
    ("Am 7. Mai 1917 kam er, z. B. in Nr. 3. Dann ging er.", ["Am 7. Mai 1917 kam er, z. B. in Nr. 3.", "Dann ging er."]),
    ("« Il faut agir. Il faut voter », dit Mme. Oxl. Pourquoi ? Le no. 4.", ["« Il faut agir. Il faut voter », dit Mme. Oxl.", "Pourquoi ?", "Le no. 4."]),
    ("They brought papers, etc. The end, i.e. £4 paid.", ["They brought papers, etc.", "The end, i.e. £4 paid."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in sentence_spans(text, {})] == want


def test_document_and_corpus_evidence():
    text = "The Bgt. of Ox came. The Bgt. Oxmere spoke to Oxmere."
    assert len(sentence_spans(text, {})) == 2
    assert len(sentence_spans("Visc. Oxmere spoke.", {"Visc": TITLE})) == 1 and len(sentence_spans("Visc. Oxmere spoke.", {})) == 2


def test_document_comes_before_the_lexicon():
    shown = "We met Smith Ltd. of Ox and saw Harris. They of Smith Ltd. Harris came."
    assert [shown[a:b] for a, b in sentence_spans(shown, {})] == ["We met Smith Ltd. of Ox and saw Harris.", "They of Smith Ltd. Harris came."]
    assert len(sentence_spans("They of Smith Ltd. Harris came.", {})) == 2 and len(sentence_spans("They of Smith Ltd. Harris came.", {"Ltd": TITLE})) == 1
    long = "The Commiss. of Ox saw Oxmere. The Commiss. Oxmere spoke."
    assert len(sentence_spans(long, {})) == 2
    assert len(sentence_spans("The hon. members rose. The hon. Member spoke.", {"hon": ABBR})) == 2


def test_a_word_that_the_document_writes_bare():
    gen = "Our Gen, too. I like Gen. Then we left."
    assert [gen[a:b] for a, b in sentence_spans(gen, {})] == ["Our Gen, too.", "I like Gen.", "Then we left."]
    assert len(sentence_spans("We saw Gen. Smith. He met Gen Jones.", {})) == 2
    battn = "We met the Battn. in May, the Battn. of 1812 too. Then Battn. Smith led it."
    assert [battn[a:b] for a, b in sentence_spans(battn, {})] == ["We met the Battn. in May, the Battn. of 1812 too.", "Then Battn. Smith led it."]


def test_layout_changes_nothing(spark):
    texts = [f"They saw Visct. Ox{i} here. The court of Visct. Al{i % 7} rose, and the Battn. of ox{i} too." for i in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "speech_id long, body string")
    layouts = [rows.coalesce(1), rows.repartition(2), rows.repartition(7)]
    found = [sorted(map(tuple, sentences(x, "speech_id", "body").collect())) for x in layouts]
    facts = [sorted(map(tuple, corpus_facts(x, "body").collect())) for x in layouts]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found.append(sorted(map(tuple, sentences(rows, "speech_id", "body").collect())))
        facts.append(sorted(map(tuple, corpus_facts(rows, "body").collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert all(x == found[0] for x in found) and all(x == facts[0] for x in facts)
    assert len(found[0]) == 160 and any(w == "Visct" for w, _ in facts[0])


def test_facts_by_a_join(spark, monkeypatch):
    texts = [t for t, _ in CASES] + ["The Bgt. of Ox came. The Bgt. Oxmere spoke to Oxmere."] + [f"Visc. Ox{i} spoke to Al." for i in range(9)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "speech_id long, body string")
    want = sorted(map(tuple, sentences(rows, "speech_id", "body").collect()))
    monkeypatch.setattr(module, "FACTS", 0)
    assert sorted(map(tuple, sentences(rows, "speech_id", "body").collect())) == want


def test_spans_cover_all_text():
    text = " \n ".join(t for t, _ in CASES) + "\r\n\f“unclosed (. x"
    spans = sentence_spans(text, {})
    assert all(text[a:b] == text[a:b].strip() and a < b for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    left = set(range(len(text))) - {i for a, b in spans for i in range(a, b)}
    assert all(text[i].isspace() for i in left)


def test_operator(spark, clash):
    rows = [(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, ""), (4, " \n "), (None, "Yes."), (5, "x" * 300_000)]
    df = clash(spark.createDataFrame(rows, "speech_id long, body string"))
    got = sorted(map(tuple, sentences(df, "speech_id", "body").collect()), key=str)
    assert got == sorted([(1, 0, 4), (1, 5, 9), (None, 0, 4), (5, 0, 300_000)], key=str)
    assert sentences(df.limit(0), "speech_id", "body").count() == 0
