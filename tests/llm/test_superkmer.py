import hashlib
import random

import numpy as np
import pytest

from cityweave.llm import superkmer


def brute(rows, window):
    """rows: (doc_id, text), each id once or in equal rows."""
    split = lambda t: [w for w in (t or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]
    first = {}
    for i, t in sorted({x for x in rows}, key=lambda x: (x[0] is None, x[0] or 0)):
        w = split(t)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone |= set(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["a", "b", "é", "dd", "E", "ff"]
    passages = [[r.choice(vocab) for _ in range(r.randint(10, 40))] for _ in range(5)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(passages) if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randint(1, 25))]
        rows.append((k * 3 % n if n % 3 else k, r.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(1000, "x " * 300), (1001, None), (1002, ""), (rows[4]), (None, rows[7][1])]


@pytest.mark.parametrize("window,options", [(20, {}), (20, {"flush_bytes": 300, "n_buckets": 7}), (8, {"n_buckets": 3}), (20, {"bucket_text": 60, "n_buckets": 11})])
def test_equals_brute_force(spark, window, options):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int").repartition(3)
    got = superkmer.removals(docs, window=window, **options).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_hash_collisions_are_settled(monkeypatch):
    monkeypatch.setattr(superkmer, "window_hash", lambda h, w: np.zeros(len(h) - w + 1, np.uint64))
    texts = [b"a b c d e", b"c d e f", b"x y z"]
    ids, lo, hi = (x.tolist() for x in np.array(superkmer.bucket_repeats(texts, np.array([1, 2, 3]), np.zeros(3, np.int64), np.zeros(3, np.int64), 3))[[0, 2, 3]])
    assert (ids, lo, hi) == ([2], [0], [3])


def test_empty_and_rewritten_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert superkmer.removals(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, long, "s"), (2, "before  it\n" + long, "s"), (3, "as  it\nwas ", "s"), (4, None, "s")], "doc_id long, text string, _spans_ string")
    got = {r.doc_id: r.text for r in superkmer.without_repeats(docs).collect()}
    assert got == {1: long, 2: "before it", 3: "as  it\nwas ", 4: None}


def test_hot_minimisers_are_dealt_further(spark, monkeypatch):
    """A piece that very many different windows share: its windows spread over many buckets, the result stays."""
    r = random.Random(9)
    hot_piece = "low a hash piece"
    rows = [(k, " ".join(f"{r.choice('abcdefg')}{r.randint(0, 40)}" for _ in range(22)) + f" {hot_piece} " + " ".join(f"{r.choice('hijk')}{r.randint(0, 40)}" for _ in range(22))) for k in range(150)]
    rows += [(500 + k, rows[k][1]) for k in range(40)]
    monkeypatch.setattr(superkmer, "SAMPLE_LEAST", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    body = docs.select(superkmer.F.col("doc_id").alias("id"), superkmer.F.lit(0).cast("long").alias("key"), superkmer.F.col("text").cast("binary").alias("body"))
    hot = superkmer.hot_minimisers(body, 10_000, 20, 600)
    assert len(hot)
    words = [w.encode() for _, t in rows for w in t.split()]
    starts = np.cumsum([0] + [len(t.split()) for _, t in rows[:-1]])
    plain, dealt = superkmer.super_kmers(words, starts), superkmer.super_kmers(words, starts, hot=hot)
    most = lambda x: max(np.bincount(np.unique(x[2], return_inverse=True)[1], x[1]))
    assert plain[1].sum() == dealt[1].sum() and most(dealt) <= most(plain)
    assert sorted(map(tuple, superkmer.removals(docs, bucket_text=600).collect()), key=str) == brute(rows, 20)


def test_long_text_and_clashing_names(spark):
    r = random.Random(10)
    long = " ".join(r.choice("abcdefghij") + str(r.randint(0, 3000)) for _ in range(25_000))
    names = ["span_id", "span_key", "spans", "_id", "_key", "_spans"]
    docs = spark.createDataFrame([(1, long, *range(6)), (2, "x " + long, *range(6))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = superkmer.without_repeats(docs).orderBy("doc_id").collect()
    assert [r.text for r in got] == [long, "x"] and all(list(r)[2:] == list(range(6)) for r in got)
    assert superkmer.removals(docs).where("n_removed > 0").count() == 1
