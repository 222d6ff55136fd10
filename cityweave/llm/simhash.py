"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance.

Method: a binary trie over the fingerprints is joined with itself. Pairs of trie nodes are walked together from the
root; each step takes the next bit of both, adds one error where the bits differ, and drops the pair once the errors
exceed the budget. The trie is held implicitly: a node is a range of a sorted array, so the walk is a sequence of
numpy steps over all node pairs of one depth.

Distribution: with a budget of d, two linked fingerprints agree on at least one of d + 1 blocks of bits. Every distinct
fingerprint goes once to each block's value, its bits turned so that this block comes first, and the walk starts below it.
A value that more than `REFINE` fingerprints share is taken apart by the same rule: the bits that are left make d + 1 blocks
again, and linked fingerprints agree on one of those too. What that doesn't make much smaller (fingerprints that are all
near each other) and other large groups are cut into chunks by hash, `PARTS` at most, and every pair of chunks is walked by
itself. So rows grow with the fingerprints and not with their pairs, no task holds all of a large group, and no link is lost.
Each task returns a spanning forest of its links; the forests are merged by alternating large-star and small-star rounds
over written tables.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; repeated
rows each get a row; null ids are returned, never chosen as a component's id unless it has no other (then null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.llm.base import discard, free_names, map_batches, materialize, partitions_for, text_hash

SEED = 42
BITS = 64
SHINGLE_WORDS = 3
BUDGET = 2
#: Fingerprints of one block value from which it is taken apart by further bits.
REFINE = 256
#: Fingerprints of a chunk, about, and chunks of a group at most.
CHUNK, PARTS = 64, 32
#: Links that a walk holds before it reduces them to a forest.
LINKS = 1 << 22
#: Rows that a task walks, about.
TASK_ROWS = 100_000
#: Node pairs of one depth that are expanded at once.
FRONTIER = 1 << 20


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> bytes:
    """The 8 bytes (big-endian) of a text's fingerprint. Words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    n = max(1, len(words) - shingle_words + 1)
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at : at + (1 << 15) + shingle_words - 1]
        if len(words) < shingle_words:
            raw = digest(b" ".join(part), SEED)
        else:
            raw = b"".join([digest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(shingle_words)))])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), fingerprint (16 hex digits), text_key (xxhash64 of the text)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("body"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [fingerprint(x) for x in b.column("body").to_pylist()]
            fp = np.frombuffer(b"".join(raw), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), pa.array([x.hex() for x in raw], pa.string()), b.column("text_key")], ["doc_id", "fp", "fingerprint", "text_key"])

    return map_batches(narrow, each, "doc_id long, fp long, fingerprint string, text_key long")


def trie_join(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: int = BUDGET) -> np.ndarray:
    """Index pairs of `keys` (uint64) within `budget` differing bits, for the given pairs of trie nodes; of more than `LINKS`
    pairs a forest.

    keys is sorted within each node; pairs has rows (lo_a, hi_a, lo_b, hi_b), a node joined with itself where both
    ranges are equal. Keys of a pair's two nodes agree on their first `depth` bits and are distinct.
    """
    found: list[np.ndarray] = []
    held = 0
    stack = [(depth, pairs.astype(np.int64), np.zeros(len(pairs), np.int64))]
    while stack:
        d, p, err = stack.pop()
        single = (p[:, 1] - p[:, 0] == 1) & (p[:, 3] - p[:, 2] == 1)
        if single.any():
            leaf = p[single]
            leaf = leaf[leaf[:, 0] != leaf[:, 2]]
            near = np.bitwise_count(keys[leaf[:, 0]] ^ keys[leaf[:, 2]]) <= budget
            found.append(leaf[near][:, [0, 2]])
            held += len(found[-1])
            if held > LINKS:
                label = forest(len(keys), np.concatenate(found))
                found = [np.stack([moved := np.flatnonzero(label != np.arange(len(keys))), label[moved]], 1)]
                held = len(moved)
            p, err = p[~single], err[~single]
        if not len(p) or d == BITS:
            continue
        if len(p) > FRONTIER:
            half = len(p) // 2
            stack += [(d, p[:half], err[:half]), (d, p[half:], err[half:])]
            continue
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int64)))
        a, b = p[:, 1] - (ones[p[:, 1]] - ones[p[:, 0]]), p[:, 3] - (ones[p[:, 3]] - ones[p[:, 2]])
        same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        child = [
            (np.stack([p[:, 0], a, p[:, 2], b], 1), err, np.ones(len(p), bool)),
            (np.stack([a, p[:, 1], b, p[:, 3]], 1), err, np.ones(len(p), bool)),
            (np.stack([p[:, 0], a, b, p[:, 3]], 1), err + 1, np.ones(len(p), bool)),
            (np.stack([a, p[:, 1], p[:, 2], b], 1), err + 1, ~same),
        ]
        keep = [w & (q[:, 0] < q[:, 1]) & (q[:, 2] < q[:, 3]) & (e <= budget) for q, e, w in child]
        stack.append((d + 1, np.concatenate([q[k] for (q, _, _), k in zip(child, keep)]), np.concatenate([e[k] for (_, e, _), k in zip(child, keep)])))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def forest(n: int, links: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links reach."""
    label = np.arange(n)
    while len(links):
        low = np.minimum(label[links[:, 0]], label[links[:, 1]])
        np.minimum.at(label, label[links[:, 0]], low)
        np.minimum.at(label, label[links[:, 1]], low)
        while (label[label] != label).any():
            label = label[label]
        links = links[label[links[:, 0]] != label[links[:, 1]]]
    return label


def taken_apart(keyed: DataFrame, budget: int) -> DataFrame:
    """keyed (fp, turned: its bits, of which the first `depth` are agreed on, path) once for each of budget + 1 blocks of the bits left.

    Each row's block comes next in turned; depth grows by its width, value holds the bits agreed on, path the blocks taken."""
    each = keyed.select("*", F.explode(F.array(*(F.lit(k) for k in range(budget + 1)))).alias("k"))
    each = each.selectExpr("fp", "turned", "depth", "above", f"path * {budget + 2} + k + 1 AS path", "64 - depth AS left", f"CAST((64 - depth) * k DIV {budget + 1} AS INT) AS a", f"CAST((64 - depth) * (k + 1) DIV {budget + 1} AS INT) AS b")
    # a shift by 64 places is none in the JVM, so the first step has no mask
    each = each.selectExpr("fp", "turned", "depth", "above", "path", "left", "a", "b", "IF(left = 64, -1L, shiftleft(1L, left) - 1L) AS mask")
    moved = "(shiftleft(turned & mask, a) | IF(a = 0, 0L, shiftrightunsigned(turned & mask, left - a))) & mask"
    each = each.selectExpr("fp", f"(turned & ~mask) | ({moved}) AS turned", "depth + b - a AS depth", "above", "path")
    return each.selectExpr("fp", "turned", "depth", "above", "path", "shiftrightunsigned(turned, 64 - depth) AS value")


def groups(distinct: DataFrame, budget: int, refine: int = REFINE) -> DataFrame:
    """path, depth, value, n, fp, turned: groups of n fingerprints, in one of which every linked pair meets."""
    level, ready = distinct.selectExpr("fp", "fp AS turned", "0 AS depth", "0L AS path", "0L AS above"), None
    while True:
        keyed = taken_apart(level, budget)
        sizes = keyed.groupBy("path", "value").agg(F.count("*").alias("n")).where("n > 1")
        met = materialize(keyed.join(sizes, ["path", "value"]), "groups")
        done = (F.col("n") <= max(refine, 1 << budget)) | ((F.col("above") > 0) & (F.col("n") > F.col("above") / 4))
        part = met.where(done).drop("above")
        ready = part if ready is None else ready.union(part)
        level = met.where(~done).select("fp", "turned", "depth", "path", F.col("n").alias("above"))
        if level.isEmpty():
            return ready


def links(distinct: DataFrame, budget: int = BUDGET, chunk: int = CHUNK, refine: int = REFINE) -> DataFrame:
    """u, v: a forest, per task, of the links among the distinct longs in column fp."""
    parts = F.least(F.ceil(F.col("n") / chunk), F.lit(PARTS)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = groups(distinct, budget, refine).withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("path", "depth", "value", "fp", "turned", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    n = partitions_for(distinct.sparkSession, dealt.count(), TASK_ROWS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        c = {k: t.column(k).to_numpy() for k in t.column_names}
        key = c.pop("turned").view(np.uint64)
        order = np.lexsort((key, c["own"], c["second"], c["first"], c["value"], c["path"]))
        c, key = {k: v[order] for k, v in c.items()}, key[order]
        differ = lambda *names: np.any([c[k][1:] != c[k][:-1] for k in names], axis=0)
        node = np.flatnonzero(np.concatenate(([True], differ("path", "value", "first", "second", "own"))))
        end = np.append(node[1:], len(key))
        alone = c["first"][node] == c["second"][node]
        pair = np.stack([node, end, node, end], 1)[alone]
        # two chunks of one pair are next to each other
        left = np.flatnonzero(~alone[:-1] & ~alone[1:] & ~np.concatenate(([True], differ("path", "value", "first", "second")))[node[1:]])
        pair = np.concatenate([pair, np.stack([node[left], end[left], node[left + 1], end[left + 1]], 1)])
        depth = c["depth"][pair[:, 0]]
        values, at = np.unique(c["fp"], return_inverse=True)
        label = np.arange(len(values))
        for d in np.unique(depth):
            met = at[trie_join(key, pair[depth == d], int(d), budget)]
            label = forest(len(values), np.concatenate([met, np.stack([np.arange(len(values)), label], 1)]))
        moved = np.flatnonzero(label != np.arange(len(values)))
        yield pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[label[moved]])], ["u", "v"])

    return dealt.repartition(n, "path", "value", "first", "second").mapInArrow(walk, "u long, v long")


#: Rows of a node beyond which its value is broadcast instead of shuffling its rows to one task, and how many such there may be.
HUB_ROWS, HUBS = 1000, 10_000
#: Rows that one task may join whatever their nodes, and rows of a file of a round.
FEW_ROWS, FILE_ROWS = 500_000, 100_000


def with_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """rows joined with least (u, m, n rows of u) by u. Nodes of very many rows are broadcast, 2 * `HUBS` of them at most.

    Of at most `FEW_ROWS` rows a node's go to one task, which spares the stages that look for such nodes."""
    if n_rows <= FEW_ROWS:
        return rows.join(least.select("u", "m"), "u")
    many = F.col("n") > max(HUB_ROWS, n_rows // HUBS)
    hubs = F.broadcast(least.where(many).select("u", "m"))
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(least.where(~many).select("u", "m"), "u"))


def stars(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """node, root: for every node of the edges u, v the smallest node that it reaches (alternating large and small stars).

    Rounds go on until one changes nothing. Their files hold about `FILE_ROWS` rows, so a round of few rows has few tasks,
    however many partitions the session's shuffles have: the driver keeps what every task reports."""
    state = None
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    n_rows = e.count()
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_least(both, low, n_rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        files = max(1, -(-2 * n_rows // FILE_ROWS))
        large = materialize(large.coalesce(files), tag)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, n_rows).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        before, e = e, materialize(small.coalesce(files), tag)
        discard(before)
        discard(large)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, n_rows = now, now[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, chunk: int = CHUNK, refine: int = REFINE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id (smallest id reachable), component_key, text_key."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    root = stars(links(distinct.select("fp"), budget, chunk, refine))
    of = distinct.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id", F.col("root").alias("component_key"))
    return marked.join(named, "fp").select("doc_id", "fingerprint", "component_id", "component_key", "text_key")


def row_rank() -> Column:
    """Orders the rows (doc_id, text_key) of one component: the least of them stays."""
    return F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), F.col("text_key").alias("k"), F.col("doc_id").alias("d"))


def keep_first(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose row_rank() is column x of kept; of equal rows, one. Columns of docs may have any names."""
    i, k, n = free_names(docs, "rank_id", "rank_key", "rank_number")
    kept = kept.select(F.col("x.i").alias(i), F.col("x.k").alias(k))
    rows = docs.withColumn(i, F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))).withColumn(k, text_hash(F.col(text_col)))
    first = F.row_number().over(Window.partitionBy(i, k).orderBy(F.lit(1)))
    return rows.join(kept, [i, k], "left_semi").withColumn(n, first).where(F.col(n) == 1).select(*docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """docs with one row of each component: that of the smallest id (of equal ids, the smallest text hash; of equal rows, one)."""
    marked = near_duplicates(docs, id_col, text_col, budget)
    return keep_first(docs, marked.groupBy("component_key").agg(F.min(row_rank()).alias("x")), id_col, text_col)
