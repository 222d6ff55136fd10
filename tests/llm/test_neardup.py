import random

import numpy as np

import corpus_pipeline
from cityweave.llm import neardup


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Ids that stay: the smallest of each component of pairs with a Jaccard similarity of 0.8 at least."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or 10 * len(sets[a] & sets[b]) >= 8 * union:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted(low.values())


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for base in ([word() for _ in range(r.randint(60, 200))] for _ in range(15)):
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 25)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows + [(500, None), (501, ""), (502, "One two"), (503, "ONE\ttwo"), (504, "one three")]


def test_stage_removes_near_copies_of_several_edits(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute(rows)
    for chunk in (3, 1):
        assert sorted(r.doc_id for r in neardup.drop_near_copies(docs, chunk=chunk).collect()) == got


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "quite another text here"), (None, None), (None, "")]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, node string")
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, None]


def test_chunks_by_bytes_and_by_number_keep_the_same_rows(spark, monkeypatch):
    import random

    r = random.Random(11)
    base = [[f"w{r.randint(0, 9999)}" for _ in range(300)] for _ in range(6)]
    rows = []
    for k in range(90):
        words = list(base[k % 6])
        for _ in range(r.randint(0, 12)):
            words[r.randrange(300)] = f"x{r.randint(0, 9999)}"
        rows.append((k, " ".join(words)))
    rows.append((500, " ".join(f"long{k}" for k in range(40_000))))  # a set larger than a chunk
    rows.append((501, " ".join(f"long{k}" for k in range(39_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    for chunk, size in ((1024, 64 << 20), (4, 64 << 20), (1024, 9_000)):
        monkeypatch.setattr(neardup, "CHUNK_BYTES", size)
        monkeypatch.setattr(neardup.components, "__defaults__", (size,))
        assert sorted(x.doc_id for x in neardup.drop_near_copies(df, chunk=chunk).collect()) == want


def test_the_trie_proposes_what_no_band_does(spark, monkeypatch):
    """Sets of near fingerprints are compared though they share no band, and linked only if they are similar."""
    base = [f"w{k}" for k in range(400)]
    near = base[:200] + ["other"] + base[200:]
    docs = spark.createDataFrame([(2, " ".join(base)), (1, " ".join(near)), (3, " ".join(f"v{k}" for k in range(400)))], "doc_id long, text string")
    monkeypatch.setattr(neardup, "band_values", lambda h: [int(h[0] >> np.uint64(1)) + len(h)])
    a, b = (neardup.fingerprint(neardup.shingles(" ".join(x).encode())) for x in (base, near))
    assert 0 < (a ^ b) % 2**64 and ((a ^ b) % 2**64).bit_count() <= neardup.TRIE_BUDGET
    assert sorted(r.doc_id for r in neardup.drop_near_copies(docs).collect()) == [1, 3]
