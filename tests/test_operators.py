import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostra.operators import clusters, metrics, retrieval, store, strata
from rostra.sources import html, logs, nested, tables
from rostra.streaming import latest as stream

ROW = {"speech_id": 1, "prompt_hash": "h", "model_id": "m", "temperature": 0.0, "seed": None, "rep": 0, "raw_text": "Yes.\n- a", "output_format": "free", "task": "v1", "ts": 1.0, "run_id": "r1"}


def test_draw_is_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("speech_id"), (F.col("id") % 3).alias("era"))
    one = strata.stratified(df, ["era"], "speech_id", 7, 1).select("speech_id", "sampling_weight").collect()
    two = strata.stratified(df.repartition(9), ["era"], "speech_id", 7, 1).select("speech_id", "sampling_weight").collect()
    assert sorted(one) == sorted(two) and len(one) == 21


def test_verification_draws_each_key_once(spark):
    df = spark.createDataFrame([(i % 30,) for i in range(90)] + [(None,)], "k int")
    one = [r["k"] for r in strata.verification(df, "k", 12, 1).collect()]
    assert len({*one}) == 12 and None not in one and one == [r["k"] for r in strata.verification(df.repartition(7), "k", 12, 1).collect()]
    assert strata.verification(df, "k", 100, 1).count() == 30 and one != [r["k"] for r in strata.verification(df, "k", 12, 2).collect()]


def test_alpha_by_hand(spark):
    rows = [(1, True), (1, True), (2, True), (2, False), (3, False), (3, None)]
    got = metrics.krippendorff(spark.createDataFrame(rows, "u int, v boolean"), ["u"], "v").first()
    assert (got["alpha"], got["units"]) == (0.0, 2)
    same = metrics.krippendorff(spark.createDataFrame([(1, True), (1, True)], "u int, v boolean"), ["u"], "v").first()
    assert same["alpha"] == 1.0


def test_ranking_with_ties(spark):
    rows = [(0, 0.9, 1), (0, 0.8, 0), (0, 0.8, 1), (0, 0.1, 0), (1, 0.5, 1)]
    got = metrics.ranking(spark.createDataFrame(rows, "q int, s double, y int"), ["q"], "s", "y").collect()
    assert len(got) == 1 and got[0]["auroc"] == 0.875 and got[0]["ap"] == pytest.approx(0.833333, abs=1e-6)


def test_core_grid_keeps_nulls(spark):
    df = spark.createDataFrame([("temp0", None, "current"), ("temp0", "v1_nocap", "current"), ("temp07", "v1", "current")], "condition string, task string, definition string")
    assert metrics.core_grid(df).count() == 1


def test_rank_agreement_pairs_every_ranking(spark, tmp_path):
    from rostra.plans.core import QUERIES

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(120, 4)).round(3)
    rows = [(i, i % 7, v.tolist()) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    cosine = lambda a, b: round(float(a @ b / ((np.linalg.norm(a) + 1e-12) * (np.linalg.norm(b) + 1e-12))), 9)
    score = {q: np.array([cosine(v, vectors[q]) for v in vectors]) for q in range(7)}
    rank = {q: np.array([(s < x).sum() + ((s == x).sum() + 1) / 2 for x in s]) for q, s in score.items()}
    top = {q: {*sorted(range(120), key=lambda i: (-s[i], i))[:100]} for q, s in score.items()}
    got = {(r["a"], r["b"]): r for r in QUERIES["met9_rank_agreement"][0](spark, str(tmp_path)).collect()}
    assert set(got) == {(a, b) for a in range(7) for b in range(a + 1, 7)}
    for (a, b), r in got.items():
        assert r["spearman"] == pytest.approx(np.corrcoef(rank[a], rank[b])[0, 1], abs=2e-6)
        assert (r["overlap"], r["n"]) == (len(top[a] & top[b]) / 100, 120)


def test_theme_agreement_counts_every_call(spark, tmp_path, monkeypatch):
    import itertools
    import random

    from rostra.functions.vectors import hashed_embedding
    from rostra.operators import reports
    from rostra.plans.more import QUERIES

    rng = random.Random(3)
    themes = ["rents", "damp housing", "housing damp", "fever", "fever hospitals", "schools", "poor schools"]
    calls = [(s, f"m{rng.randint(0, 2)}", rep, rng.random() < 0.9, rng.choices(themes, k=rng.randint(0, 3))) for s, n in ((1, 60), (2, 5), (3, 1)) for rep in range(n)]
    rows = [*calls, calls[0], calls[7], (4, "m0", 0, True, None)]
    spark.createDataFrame(rows, "speech_id long, model_id string, rep int, mentions_topic boolean, subthemes array<string>").write.parquet(str(tmp_path / "extraction.parquet"))
    embed = hashed_embedding(64).func
    vector = dict(zip(themes, map(np.array, embed(pd.Series(themes)))))

    def jaccard(a, b):
        free, met = list(b), 0
        for x in a:
            best = max(free, key=lambda y: round(vector[x] @ vector[y], 9), default=None)
            if best is not None and vector[x] @ vector[best] >= 0.72:
                free.remove(best)
                met += 1
        return met / (len(a) + len(b) - met)

    want = {}
    for s in (1, 2, 3):
        lists = [t for k, _, _, yes, t in calls if k == s and yes and t]
        if pairs := [jaccard(a, b) for a, b in itertools.combinations(lists, 2)]:
            want[s] = (pytest.approx(np.mean(pairs), abs=2e-6), len(pairs))
    assert want[1][1] > 500
    for block in (256, 5):
        monkeypatch.setattr(reports, "BLOCK", block, raising=False)
        got = {r["speech_id"]: (r["agreement"], r["pairs"]) for r in QUERIES["met12_theme_agreement"][0](spark, str(tmp_path)).collect()}
        assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    nodes = [(i,) for i in range(41)] + [(100,), (101,), (7777,)]
    got = dict(clusters.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(nodes, "node long")).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[7777] == 7777


def test_speakers(spark):
    rows = [("Mr. John Smith", "1900-01-01"), ("john smith said", "1901-01-01"), ("John Smyth", "1950-01-01"), ("Jane Jones", "1890-01-01"), ("  ", "1890-01-01"), (None, None)]
    got = clusters.speakers(spark.createDataFrame(rows, "speaker string, date string")).orderBy("person_id").collect()
    assert [(r["person_id"], r["canonical_name"], r["n_rows"]) for r in got][0] == ("P00001", "jane jones", 1)
    assert sum(r["n_rows"] for r in got) == 4


def test_average_linkage():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [-1, 0.0]])
    labels = clusters.average_linkage(v, 0.35)
    assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3
    assert list(clusters.average_linkage(v[:1], 0.35)) == [0]


def test_pooled_and_missing(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc long")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vec array<double>")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "doc long, vector array<double>")
    scored = retrieval.dense_scores(chunks, queries, "doc", "vector")
    got = {r["doc"]: (round(r["best"], 6), round(r["mean"], 6)) for r in retrieval.pooled_chunks(docs, queries, scored, "doc").collect()}
    assert got == {1: (1.0, 0.5), 2: (0.0, 0.0)} and retrieval.best_chunk(scored, "doc").count() == 1
    assert retrieval.missing(docs, docs.limit(1), "doc").count() == 1
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two.")], "doc long, text string")
    assert [tuple(r) for r in retrieval.chunk_rows(empty, "doc", "text").collect()] == [(3, 0, "One. Two.")]


def write_run(root, run, rows):
    at = root / "exp" / run
    at.mkdir(parents=True)
    (at / "results.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_store(spark, tmp_path):
    write_run(tmp_path, "r1", [ROW, "", "{broken", ROW | {"rep": 1, "error": "timeout", "raw_text": None}])
    write_run(tmp_path, "r2", [ROW | {"raw_text": "No.", "run_id": "r2"}])
    rows = logs.read_experiment(spark, str(tmp_path), "exp")
    assert rows.count() == 3 and rows.filter("definition <> 'current'").count() == 0
    assert logs.read_experiment(spark, str(tmp_path), "unknown").count() == 0
    new = store.latest(rows)
    assert {(r["rep"], r["raw_text"]) for r in new.select("rep", "raw_text").collect()} == {(0, "No."), (1, None)}
    again = {r["rep"]: r for r in store.reparsed(new).collect()}
    assert again[0]["mentions_topic"] is False and again[1]["parse_error"] == "timeout" and again[1]["parse_ok"] is False
    assert store.done_cells(rows).count() == 1
    dims = spark.createDataFrame([("h",)], "prompt_hash string"), spark.createDataFrame([("m",)], "model_id string"), spark.createDataFrame([(0.0, None, 2)], "temperature double, seed long, reps int")
    left = store.jobs(spark.createDataFrame([(1,), (2,)], "speech_id long"), *dims, store.done_cells(rows))
    assert left.count() == 3
    ran = store.execute(left.select("speech_id"), lambda r: {"speech_id": r["speech_id"], "text": "ok"}, "speech_id long, text string", 2)
    assert ran.count() == 3
    with pytest.raises(Exception, match="."):
        logs.read_log(spark, str(tmp_path / "exp" / "r1"), tolerant=False).collect()
    budgets = spark.createDataFrame([("v1", 512), ("v1_nocap", 512), ("v1_nocap", 4096)], "task string, most int")
    assert [r[0] for r in budgets.select(store.token_budget(F.col("task"), F.col("most"))).collect()] == [512, 1024, 4096]
    facts = logs.write_manifest(str(tmp_path / "m" / "manifest.json"), experiment="exp")
    assert json.loads((tmp_path / "m" / "manifest.json").read_text())["experiment"] == facts["experiment"]


def test_stream_keeps_the_latest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps(ROW) + "\n" + json.dumps(ROW | {"rep": 7}) + "\n")
    for step in range(4):
        stream.keep_latest(stream.stream_logs(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck"), buckets=5).awaitTermination()
        got = stream.read_latest(spark, str(tmp_path / "out")).select("rep", "raw_text").collect()
        want = {(0, ROW["raw_text"])} if not step else {(0, f"No {step}."), (1, ROW["raw_text"])}
        assert {tuple(r) for r in got} == want | {(7, ROW["raw_text"])} and len(got) == len(want) + 1
        (source / f"b{step}.json").write_text(json.dumps(ROW | {"raw_text": f"No {step + 1}.", "run_id": f"r{step + 2}"}) + "\n" + json.dumps(ROW | {"rep": 1}) + "\n")
    kept = stream._versions(spark, str(tmp_path / "out"))
    assert all(sum(c == b for c, _ in kept) <= 2 for b, _ in kept)


def test_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none"))
    (tmp_path / "x.csv").write_text('a,b\n1,"x ""y"" z"\n')
    got = tables.read_strings(spark, str(tmp_path / "x.csv"), ["c"]).first()
    assert (got["a"], got["b"], got["c"]) == ("1", 'x "y" z', None)
    spark.range(10).repartition(5).write.parquet(str(tmp_path / "p1"))
    tables.compact(tables.read_many(spark, str(tmp_path / "p*")), str(tmp_path / "q"), 1)
    assert tables.read_table(spark, str(tmp_path / "q"), "v").count() == 10


def test_transcripts(spark):
    day = {"day": "1900-01-01", "data": {"chambers": {"c": [{"title": "A", "content": [{"speaker": "x", "text": "1"}], "subsections": [{"title": "B", "content": [{"speaker": "y", "speech": "2"}]}]}, {"title": "C", "content": [{"speaker": "z"}]}]}}}
    df = spark.createDataFrame([(json.dumps(day),), ("",), ("[1]",), ("{broken",), (None,)], "value string")
    got = [tuple(r) for r in nested.transcript_rows(df).select("title", "speaker", "speech").collect()]
    assert got == [("A", "x", "1"), ("B", "y", "2"), ("C", "z", "")]


@pytest.mark.parametrize("shape", ['[%s]', '[{"value": %s}]', '{"items": [{"value": %s}]}', '{"value": %s}', '%s'])
def test_members(spark, shape):
    one = '{"id": 7, "nameDisplayAs": " ", "nameListAs": "Jo", "latestParty": {"abbreviation": "W"}}'
    got = nested.member_core(nested.member_records(spark.createDataFrame([(shape % one,)], "j string"), "j")).first()
    assert tuple(got) == (7, "Jo", "W", "House of Lords")


def test_party_rows(spark):
    bios = spark.createDataFrame([("P1", "Jo Lee", "j. lee; jo lee", json.dumps({"party_affiliation": [{"party": "Lab", "start_year": "1990", "end_year": None}, {"party": " "}]})), ("P2", "x", None, None)], "person_id string, canonical_name string, aliases string, bio string")
    raw = spark.createDataFrame([("jo lee", "Mr. Jo Lee")], "clean string, raw string")
    got = {tuple(r) for r in nested.party_rows(bios, raw, {"Lab": "Labour"}).collect()}
    assert got == {("Mr. Jo Lee", "Labour", 1990, None), ("j. lee", "Labour", 1990, None)}


def test_html(spark):
    cal = '<a class="day-link" aria-label="Has business. Wednesday 11 March 2020">x</a><a class="day-link" aria-label="No business">'
    assert html.business_dates(cal) == ["2020-03-11"]
    menu = '<div class="dropdown-menu"><div>HTML Downloads</div><a class="dropdown-item" href="/a.html">A</a></div>'
    assert html.download_links(menu, "http://h") == ["http://h/a.html"]
    page = '<div class="hentry member_contribution"><cite class="member author entry-title"><a href="/p">Jo</a></cite><p>Hi <b>there</b></p></div>'
    assert html.contributions(page, "http://h") == [("Jo", "http://h/p", "Hi there")] and html.contributions("<p>Page  not found") == []
    assert html.contributions("<p>one<p>two") == [("", "", "one"), ("", "", "two")]
    lists = '<ol><li><span class="section-link"><a href="/s">S</a></span><ol><li><span class="section-link"><a href="/t">T</a></span></li></ol></li></ol>'
    assert html.sections(lists, "h") == [("S", "h/s", 0), ("T", "h/t", 1)]
    wiki = '<div id="mw-content-text"><div class="mw-parser-output"><p>P</p></div></div><table class="infobox"><tr><th>K</th><td>V</td></tr></table>'
    assert html.article_text(wiki) == "Main text:\n\nP\n\nInfobox:\n\nK: V"
    tree = '<div class="child-debate-list"><div class="child-debate"><h2>H</h2><div class="debate-item"><p>i</p></div><div class="debate-item"><div class="contribution"><a class="attributed-to-details" href="/m">M</a><div class="content"><p>c</p></div></div></div></div></div>'
    assert html.debate_tree(tree, "b") == [{"heading": "H", "items": ["i"], "contributions": [{"speaker": "M", "speaker_url": "b/m", "paragraphs": ["c"]}], "subdebates": [], "depth": 0}]
    assert html.linked_data('<script type="application/ld+json">{"a":1}</script>') == '{"a":1}'
    df = spark.createDataFrame([(cal,), (None,)], "h string")
    assert [r[0] for r in df.select(html.html_udf(html.business_dates, "array<string>")("h")).collect()] == [["2020-03-11"], None]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)]
    got = dict(clusters.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(i,) for i in range(301)], "node long")).collect())
    assert set(got.values()) == {0}


def test_names_of_a_common_sound_lose_no_pair(spark, monkeypatch):
    import random

    from rostra.functions.names import token_set_ratio

    rng = random.Random(5)
    spelled = sorted({" ".join(rng.sample(["john", "jon", "johnn", "smith", "smyth", "smithe", "de", "w"], rng.randint(1, 3))) for _ in range(150)})
    df = spark.createDataFrame([(n, "j-S530") for n in spelled], "name string, block string")
    want = {(a, b) for a in spelled for b in spelled if a < b and token_set_ratio(a, b) > 80}
    for part in (512, 7):
        monkeypatch.setattr(clusters, "PART", part)
        assert {tuple(r) for r in clusters.alike(df, 80.0).collect()} == want and len(want) > 50


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "at int, v int").repartition(5)
    assert [(r["at"], r["n"]) for r in clusters.numbered(df, ["at"], "n").orderBy("n").collect()] == [(i, i + 1) for i in range(101)]


def test_reports_are_never_cut(spark):
    from rostra.operators import reports

    for write in (lambda df: reports.markdown(df, "t", most=5), lambda df: reports.payload(df, most=5)):
        assert write(spark.range(5)) and pytest.raises(ValueError, write, spark.range(6))


def test_a_table_that_is_not_whole_stays_out(spark, tmp_path):
    from rostra.sources import tables as t

    t.compact(spark.range(10), str(tmp_path / "x"), 1, "id")
    changing = spark.range(200).filter(F.udf(lambda: __import__("random").random(), "double").asNondeterministic()() < 0.5)
    with pytest.raises(ValueError, match="expected"):
        for _ in range(20):
            t.compact(changing, str(tmp_path / "x"), 1)
    assert spark.read.parquet(str(tmp_path / "x")).count() <= 200


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import types

    from rostra import runtime

    none = types.SimpleNamespace(_jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False))), master="spark://host:7077")
    fake = types.SimpleNamespace(sparkSession=types.SimpleNamespace(sparkContext=none, conf=types.SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpointed(fake)
