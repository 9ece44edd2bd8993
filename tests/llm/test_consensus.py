import random

import numpy as np

from rostra.llm import consensus

DDL = "call_id long, speech_id long, model_id string, mentions_topic boolean, subthemes array<string>, ts double, rep int"


def grid():
    """Speeches with a planted truth, read by good annotators, a liar, a guesser and two who always say the same."""
    rng = random.Random(3)
    truth, rows = {}, []
    for s in range(150):
        truth[s] = (rng.random() < 0.4, rng.sample(["a", "b", "c", "d", "e"], 2))
        yes, themes = truth[s]
        for m in [*(f"good{i}" for i in range(5)), "liar", "coin", "always", "never"]:
            v = yes if rng.random() < 0.9 else not yes
            v = {"liar": not v, "coin": rng.random() < 0.5, "always": True, "never": False}.get(m, v)
            said = [t if rng.random() < 0.5 else f" {t.upper()} " for t in themes if rng.random() < 0.9] if m.startswith("good") else [rng.choice("abcde")]
            rows.append((len(rows), s, m, v, said if v else [], float(len(rows)), 0))
    return truth, rows


def test_consensus_and_worth(spark, clash):
    truth, rows = grid()
    late = [(*r[:5], r[5] + 1e6, r[6]) for r in rows[:40]]
    hot = [(10_000 + i, 7, "coin", True, ["e"], 1.0, i) for i in range(300)]
    odd = [(20_000, 1, "good0", None, None, 1.0, 0), (20_001, None, "good0", True, ["a"], 1.0, 0), (20_002, 2, None, True, ["a"], 1.0, 0)]
    df = clash(spark.createDataFrame(rows + rows[:60] + late + hot + odd, DDL))
    labels, annotators, _ = consensus.topic_consensus(df)
    got = {(r["speech_id"], r["label"]) for r in labels.collect()}
    topics = {s for s, (yes, _) in truth.items() if yes}
    found = {s for s, label in got if label == "mentions_topic"}
    assert len(found ^ topics) <= 3
    themes = {(s, t) for s in found & topics for t in truth[s][1]}
    assert len({(s, t) for s, t in got if t != "mentions_topic" and s in topics} ^ themes) <= len(themes) * 0.1
    alpha = {r["annotator"]: r["alpha"] for r in annotators.collect()}
    assert min(alpha[f"good{i}"] for i in range(5)) > 0.25 and alpha["liar"] < -0.1
    assert all(abs(alpha[m]) < 0.15 for m in ("coin", "always", "never"))


def test_the_vector_is_the_eigenvector(spark):
    rng = np.random.default_rng(4)
    worth, truth = np.array([0.9, 0.8, 0.6, 0.4, 0.0, -0.5]), rng.random(4000) < 0.35
    rows = []
    for i, t in enumerate(truth):
        for a, w in enumerate(worth):
            if rng.random() < 0.2 + 0.1 * a:
                rows.append((i, f"m{a}", float(t if rng.random() < (1 + w) / 2 else not t)))
    df = spark.createDataFrame(rows, "item int, annotator string, value double")
    got = {r["annotator"]: r["alpha"] for r in consensus.reliability(df).collect()}
    # The same matrix in memory: pairs over their overlap, held by the fit, by the library's eigenvector.
    table = np.full((len(truth), len(worth)), np.nan)
    for i, a, v in rows:
        table[i, int(a[1])] = v
    x = table - np.nanmean(table, axis=0)
    seen = ~np.isnan(x)
    c, n = np.nan_to_num(x).T @ np.nan_to_num(x), seen.T.astype(float) @ seen
    np.fill_diagonal(c, 0)
    np.fill_diagonal(n, 0)
    w = np.full(len(worth), 0.3)
    for _ in range(500):
        values, vectors = np.linalg.eigh((c + consensus.HOLD * np.outer(w, w)) / (n + consensus.HOLD))
        w = vectors[:, -1] * values[-1] ** 0.5
    w *= np.sign(w[0])
    assert all(abs(got[f"m{a}"] - w[a]) < 1e-3 for a in range(len(worth)))
    scale = (0.35 * 0.65) ** 0.5
    assert all(abs(got[f"m{a}"] - scale * worth[a]) < 0.06 for a in range(len(worth)))


def test_empty(spark):
    assert consensus.found(spark.createDataFrame([], DDL)).count() == 0
    one = spark.createDataFrame([(1, 1, "m", True, ["a"], 1.0, 0)], DDL)
    assert consensus.found(one).count() >= 0


def test_many_annotators_are_joined(spark, monkeypatch):
    _, rows = grid()
    df = spark.createDataFrame(rows, DDL)
    one = sorted(map(tuple, consensus.found(df).collect()))
    monkeypatch.setattr(consensus, "ANNOTATORS", 2)
    assert sorted(map(tuple, consensus.found(df).collect())) == one and len(one) > 50
