import math
import random
import zlib
from collections import Counter

import numpy as np

from cityweave.llm import brown


def corpus():
    r = random.Random(2)
    tongues = [(["the", "of", "And"], ["stone", "river.", "tree", "hill"]), (["le", "la", "et"], ["pierre", "Éau", "arbre.", "mont"])]
    rows = []
    for k in range(300):
        small, big = tongues[k % 2]
        rows.append((k, " ".join(w for _ in range(r.randint(1, 30)) for w in (r.choice(small), r.choice(big) if r.random() < 0.9 else f"rare{r.randint(0, 200)}"))))
    return rows + [(1000, None), (1001, ""), (None, "the stone"), (5, "the\tSTONE\nof"), (5, "the\tSTONE\nof")]


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split() + [""]


def test_counts_and_base_score(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, row int")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in rows), key=str)
    for common in (100_000, 8):
        got = brown.score(docs, classes=6, word_items=6, ending_items=5, most_common=common).collect()
        mine = sorted((tuple(x)[:6] for x in got), key=lambda x: (str(x[0]), str(x)))
        assert [x[:5] for x in mine] == [x[:5] for x in sorted(want, key=lambda x: (str(x[0]), str(x)))]
        assert np.allclose([x[5] for x in mine], [x[5] for x in sorted(want, key=lambda x: (str(x[0]), str(x)))])
    held_rows = [x for x in got if x.held_out]
    assert sum(x.score for x in held_rows) > sum(x.base_score for x in held_rows)


def test_model_is_a_distribution(spark):
    rows = [("the stone of the river",), ("le mont et la pierre",), ("the tree",)]
    train = spark.createDataFrame(rows, "body string").selectExpr("cast(body as binary) as body")
    counts = brown.word_counts(train)
    m = brown.fit(train, counts, classes=4, word_items=5, ending_items=3)
    assert np.allclose((10**m.transition).sum(1), 1)
    c = Counter({bytes(r.word): r.c for r in counts.collect()})
    mass = np.zeros(4)
    for w, k in c.items():
        cls = m.of[m.items.numbers([w])][0]
        mass[cls] += (k + 0.5) * 10 ** m.emission[cls]
    mass += 0.5 * 10**m.emission  # the unknown word of each class
    assert np.allclose(mass, 1)


def test_exchange_gain_equals_the_objective():
    r = np.random.default_rng(1)
    pairs = r.integers(0, 20, (30, 30))
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()

    def value(of, k=5):
        hot = np.eye(k)[of]
        g = hot.T @ pairs @ hot
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    start = np.zeros(30, np.int64)
    total = pairs.sum(1) + pairs.sum(0)
    start[np.argsort(-total[1:], kind="stable") + 1] = 1 + np.arange(29) % 4
    values = [value(start)] + [value(brown.exchange(brown.Pairs.dense(pairs), 5, k)) for k in (1, 2, 5)]
    assert values == sorted(values) and values[1] > values[0]
    best = brown.exchange(brown.Pairs.dense(pairs), 5, 50)
    for x in range(1, 30):
        for c in range(1, 5):
            other = best.copy()
            other[x] = c
            assert value(other) <= value(best) + 1e-6


def test_empty(spark):
    assert brown.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    assert brown.score(one, remainder=zlib.crc32(b"2") % 5).first().n_known == 0


def test_score_equals_brute_force(spark):
    """The model's log-probabilities from its classes by the definition, over a small corpus; ties at the broadcast cut included."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [words(t) for i, t in rows if not held(i)]
    body = spark.createDataFrame([(" ".join(t[:-1]),) for t in train], "body string").selectExpr("cast(body as binary) as body")
    counts = brown.word_counts(body)
    for common in (100_000, 9):
        opts = {"classes": 5, "word_items": 7, "ending_items": 6, "most_common": common}
        m = brown.fit(body, counts, **opts)
        cls = lambda w: int(m.of[m.items.numbers([w.encode()])][0])
        c = Counter(w for t in train for w in t)
        top = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode())) if w]
        assert set(m.items.word) - {b""} <= {w.encode() for w in top[:7]}
        ends = Counter()
        for w, k in c.items():
            if w and w.encode() not in m.items.word:
                ends[w.encode()[-3:]] += k
        assert set(m.items.ending) == {e for e, _ in sorted(ends.items(), key=lambda x: (-x[1], x[0]))[:6]}
        pair, first, then = Counter(), Counter(), Counter()
        for t in train:
            for a, b in zip(["", *t], t):
                pair[cls(a), cls(b)] += 1
                first[cls(a)] += 1
                then[cls(b)] += 1
        tokens, types = Counter(), Counter()
        for w, k in c.items():
            tokens[cls(w)] += k
            types[cls(w)] += 1
        kinds = Counter(a for a, _ in pair)

        def log(t):
            out = 0.0
            for a, b in zip(["", *t], t):
                weight = first[cls(a)] / (first[cls(a)] + kinds[cls(a)] + 1)
                uni = (then[cls(b)] + 1) / (sum(then.values()) + 5)
                p = weight * pair[cls(a), cls(b)] / max(first[cls(a)], 1) + (1 - weight) * uni
                out += math.log10(p) + math.log10((c[b] + 0.5) / (tokens[cls(b)] + 0.5 * (types[cls(b)] + 1)))
            return out

        got = sorted(((str(r.doc_id), r.score) for r in brown.score(docs, **opts).collect()))
        assert np.allclose([x[1] for x in got], [x[1] for x in sorted((str(i), log(words(t))) for i, t in rows)])


def test_long_text(spark, monkeypatch):
    r = random.Random(3)
    long = " ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(40_000))
    docs = spark.createDataFrame([(2, long), (3, "a1 b2")], "doc_id long, text string")
    one = {x.doc_id: x.score for x in brown.score(docs).collect()}
    monkeypatch.setattr(brown, "MOST_TOKENS", 1000)
    pieces = {x.doc_id: x.score for x in brown.score(docs).collect()}
    assert one.keys() == pieces.keys() and np.allclose([one[2], one[3]], [pieces[2], pieces[3]])
