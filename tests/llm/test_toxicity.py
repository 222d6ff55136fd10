import math
import random
import re
import zlib

import numpy as np

from cityweave.llm import toxicity


def corpus(n=600):
    r = random.Random(3)
    fine = ["stone", "river", "tree", "hill", "cloud", "grass"]
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        lines = [" ".join(r.choice(fine) for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 8))]
        if bad:
            at = r.randrange(len(lines))
            lines[at] += r.choice([" Wretch", " you wretch", " horribleness", " horribly"])
        rows.append((k, ". ".join(lines), int(bad)))
    return rows


def test_held_out_accuracy_and_location(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "y", 0.5) for k, t, _ in rows] + [(9000, None, "", 0.1), (9001, "", "", 0.1), (None, "a wretch", "", 0.1), (0, rows[0][1], "", 0.1)], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) + 4
    truth = {k: y for k, _, y in rows}
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.97
    text = {k: t for k, t, _ in rows}
    for x in held:
        if x.predicted and truth[x.doc_id]:
            worst = text[x.doc_id][x.offending[0]["start"] : x.offending[0]["end"]].lower()
            assert "wretch" in worst or "horribl" in worst
    assert all(x.predicted == 0 for x in got if x.doc_id in (9000, 9001))


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert abs(toxicity.score(docs, toxicity.fit(docs, none)).first().score - 0.5) < 1e-6
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_training_finds_the_feature():
    r = np.random.default_rng(1)
    flat = [[int(x) for s in range(3) for x in (*r.integers(0, 4, 2), -1)] for _ in range(50)]
    y = np.array([int(any(f[k] == 0 for k in range(len(f)))) for f in flat])
    w, b, _ = toxicity.train(y, np.full(50, 5), flat, 4)
    assert w[0] == max(w) and w[0] + b > 0


def test_gradient():
    r = np.random.default_rng(2)
    owner = np.sort(r.integers(0, 12, 30))
    sentence = np.sort(r.integers(0, 30, 70))
    ids, bare, y = r.integers(0, 5, 70), r.integers(0, 4, 12), r.integers(0, 2, 12)
    w = r.normal(size=6) * 0.7
    args = (y, ids, sentence, owner, bare)
    grad = toxicity.objective(w, *args)[1]
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        slope = (toxicity.objective(w + step, *args)[0] - toxicity.objective(w - step, *args)[0]) / 2e-6
        assert abs(slope - grad[k]) < 1e-6


def brute_score(text, weights, bias, curve):
    """Noisy-or of the sentences by the definition, then the curve over its log-odds."""
    left = 1.0
    parts = [set(re.findall(r"[^\W_]+", s.lower())) for s in re.split(r"[.!?\n]", text or "")]
    for words in [w for w in parts if w] or [set()]:
        z = bias
        for w in words:
            z += weights.get(w + "$", 0) + sum(weights.get(w[:n], 0) for n in range(3, 9) if n <= len(w))
        left *= 1 - 1 / (1 + math.exp(-z))
    odds = math.log((1 - left) / left)
    return 1 / (1 + math.exp(-(curve[0] * odds + curve[1])))


def test_scores_equal_brute_force(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "...\n!"), (903, "wretch_es! É Stone")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    assert m.weights and m.curve != (1.0, 0.0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for x in toxicity.score(docs, m).collect():
        assert abs(x.score - brute_score(texts[x.doc_id], m.weights, m.bias, m.curve)) < 1e-6


def test_repeated_training_rows_ties_and_long_texts(spark):
    """A labelled id's rows count once in any partitioning; a toxic sentence at the end of a long text is found."""
    rows = corpus(300)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    plain = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    again = plain.union(plain.where("doc_id = 8")).union(plain.where("doc_id = 8")).union(plain).repartition(7)
    a, b = toxicity.fit(plain, labels), toxicity.fit(again, labels)
    assert a.weights.keys() == b.weights.keys() and all(abs(a.weights[k] - b.weights[k]) < 1e-9 for k in a.weights)
    small = toxicity.fit(again, labels, most_rows=60)
    assert small.bias != a.bias
    long = "stone river. " * 12_000 + "you wretch."
    got = toxicity.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), a).first()
    assert abs(got.score - brute_score(long, a.weights, a.bias, a.curve)) < 1e-6
    if got.predicted:
        assert long[got.offending[0]["start"] : got.offending[0]["end"]].strip() == "you wretch"
