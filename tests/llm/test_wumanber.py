import hashlib
import random
import re

import pytest

from cityweave.llm import wumanber

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            p = split(text)
            for s in range(max(1, len(p) - window + 1)) if p and item is not None else ():
                g = p[s : s + window]
                for a in range(len(w) - len(g) + 1):
                    if w[a : a + len(g)] == g:
                        hit |= set(range(a, a + len(g)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [4 << 20, 300])
def test_equals_brute_force(spark, bound):
    r = random.Random(2)
    vocab = ["a", "B", "É", "c3", "dd"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.randint(8, 30))) for k in range(12)] + [(50, "Only. three, words"), (51, ""), (52, None), (None, "dd dd"), (53, "zz")]
    docs = [(k, text(r.randint(0, 40)) + " " + (r.choice(items)[1] or "") + " " + text(5)) for k in range(50)] + [(90, None), (91, ""), (92, "it: ONLY three words"), (93, "ZZ"), (None, "zz"), (93, "ZZ")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, spans int")
    got = wumanber.contamination(d, b, broadcast_bytes=bound).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute(docs, items)
    assert sorted(map(tuple, got), key=str) == want
    kept = wumanber.clean(d, b, broadcast_bytes=bound).collect()
    assert sorted((str(x.doc_id) for x in kept)) == sorted(str(x[0]) for x in want if not x[5])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    row = wumanber.contamination(d, b).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert wumanber.contamination(d.limit(0), b).count() == 0


def test_long_texts_names_and_repeats(spark):
    import random

    r = random.Random(7)
    long = " ".join(r.choice("abcdef") + str(r.randint(0, 50)) for _ in range(30_000))
    item = " ".join(long.split()[20_000:20_012])
    names = ["spans", "items", "hit_id", "hit_key", "n_words", "text_key", "body"]
    docs = [(1, long), (2, "a b"), (2, "a b"), (2, "a c"), (None, item)]
    d = spark.createDataFrame([(*x, *range(7)) for x in docs], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    items = [(k, f"{item} {k}") for k in range(30)] + [(k, f"{item} {k}") for k in range(3)]
    b = spark.createDataFrame(items, "item_id long, text string")
    for bound in (4 << 20, 500):
        got = wumanber.contamination(d, b, broadcast_bytes=bound).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items)
        kept = wumanber.clean(d, b, broadcast_bytes=bound)
        assert kept.columns == d.columns and sorted(tuple(x) for x in kept.collect()) == sorted((*x, *range(7)) for x in docs[1:4])


def test_tables_are_flat_and_built_once_a_block(spark, monkeypatch):
    import pickle

    r = random.Random(9)
    items = [(k, " ".join(f"w{r.randint(0, 4000)}" for _ in range(100))) for k in range(800)]
    tables = wumanber.Benchmark([(str(k), t.encode()) for k, t in items])
    assert len(pickle.dumps(tables)) < 8 * sum(len(t) for _, t in items)  # what a worker reads, once
    builds = []
    plain = wumanber.Benchmark.__init__
    monkeypatch.setattr(wumanber.Benchmark, "__init__", lambda self, rows, window=wumanber.WINDOW: (builds.append(1), plain(self, rows, window))[1])
    docs = spark.createDataFrame([(k, items[k][1]) for k in range(40)], "doc_id long, text string").repartition(20)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert wumanber.contamination(docs, b).where("n_hit = 100").count() == 40
    assert len(builds) == 1  # on the driver, whatever the number of tasks
