import random

import numpy as np
import xxhash

from cityweave.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", low.get(find(k))) for k, ((i, _), f) in enumerate(zip(rows, fps))), key=str)


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.randint(20, 120))] for _ in range(12)]
    rows = []
    for k in range(90):
        w = list(base[k % 12])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = word()
        rows.append((k, r.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "ONE\ttwo"), (205, "x y z"), (None, base[0][0]), (None, None), (7, rows[7][1]), (7, "other text of the same id")]


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    for chunk, refine in ((128, 4096), (2, 4096), (128, 4), (2, 5)):
        got = simhash.near_duplicates(docs, chunk=chunk, refine=refine).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_trie_finds_every_pair():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40, np.uint64)
    keys = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << r.integers(0, 64, 40, np.uint64)) for _ in range(6))]))
    want = {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if int(keys[a] ^ keys[b]).bit_count() <= 2}
    got = {tuple(sorted(x)) for x in simhash.trie_join(keys, np.array([[0, len(keys), 0, len(keys)]]), 0).tolist()}
    assert got == want


def test_blocks_leave_no_pair_out(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = list({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(8)} | set(base))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    label = simhash.forest(len(fps), np.array([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]))
    for chunk, refine in ((2048, 4096), (3, 4096), (3, 6)):
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), chunk=chunk, refine=refine).collect()
        at = {x: k for k, x in enumerate(signed)}
        assert (simhash.forest(len(fps), np.array([(at[a], at[b]) for a, b in found])) == label).all()


def test_empty_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "quite another text here"), (None, None), (None, "")]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, root string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, None]


def test_hot_block_values_are_taken_apart(spark, monkeypatch):
    """Fingerprints that share 40 bits: groups stay small, rows made grow linearly, every link is found."""
    r = np.random.default_rng(3)
    low = np.unique(r.integers(0, 1 << 24, 1500, np.uint64))
    low = np.unique(np.concatenate([low, low[:300] ^ np.uint64(1 << 5), low[300:500] ^ np.uint64((1 << 23) | 1)]))
    keys = np.uint64(0xABCDEF1234 << 24) | low
    df = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "fp long")
    rows = simhash.groups(df, 2, 32).groupBy("path", "value").agg({"n": "max", "fp": "count"}).collect()
    assert all(x["max(n)"] == x["count(fp)"] for x in rows)
    assert sum(x["count(fp)"] for x in rows) < 60 * len(keys)
    near = [(a, b) for a in range(len(keys)) for b in np.flatnonzero(np.bitwise_count(keys[:a] ^ keys[a]) <= 2)]
    want = simhash.forest(len(keys), np.array(near))
    at = {int(x): k for k, x in enumerate(keys.view(np.int64))}
    for chunk, refine, most in ((16, 32, simhash.LINKS), (128, 4096, 100)):
        monkeypatch.setattr(simhash, "LINKS", most)
        found = simhash.links(df, chunk=chunk, refine=refine).collect()
        assert (simhash.forest(len(keys), np.array([(at[x.u], at[x.v]) for x in found])) == want).all()


def test_long_text():
    r = random.Random(4)
    t = " ".join(r.choice(["ab", "cd", "é", "xyz", "q"]) for _ in range(70_000))
    assert simhash.fingerprint(t.encode()).hex() == f"{brute_fingerprint(t):016x}"


def test_clashing_names(spark):
    names = ["rank_id", "rank_key", "rank_number", "_i", "_k", "_n", "fp", "path"]
    docs = spark.createDataFrame([(k % 2, "same words here", *range(8)) for k in range(4)] + [(9, None, *range(8))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, *list(r)[2:]) for r in kept.collect()) == [(0, *range(8)), (9, *range(8))]


def test_rounds_of_few_rows_have_few_files(spark, monkeypatch):
    pairs = [(k, k + 1) for k in range(1, 30)] + [(500, k) for k in range(501, 1700)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    want = {k: 1 for k in range(2, 31)} | {k: 500 for k in range(501, 1700)}
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        few = simhash.stars(edges)
        assert len(few.inputFiles()) == 1
        assert dict(few.collect()) == want
        monkeypatch.setattr(simhash, "FEW_ROWS", 0)  # nodes of many rows are broadcast
        assert dict(simhash.stars(edges).collect()) == want
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
