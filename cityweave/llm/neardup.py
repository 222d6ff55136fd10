"""Near copies: documents whose sets of word shingles have a Jaccard similarity of `SIMILARITY` at least.

Method: a shingle is `SHINGLE_WORDS` words in a row (a shorter text is one shingle), held as a 64-bit hash. A set's SimHash
fingerprint has the bits that over half its hashes have; the fingerprints' binary trie is joined with itself (simhash.links)
at `TRIE_BUDGET` differing bits. Sets at the similarity sought differ in about ten bits, more than a trie can be blocked for,
so MinHash bands propose besides: two sets of similarity s meet in some band with probability 1 - (1 - s^ROWS)^BANDS, 0.99997
at 0.8. Both only propose, the trie's components as one more band's values: every link is then settled on the whole sets.
Documents that links connect are one component.

Distribution: texts of equal sets are one node. Bands are joined as hashes; the components of what they propose are
groups, and a node's set is sent to its group once. A task compares those nodes of a group that share a band's value and
that no link connects yet. A group of more than `CHUNK` nodes or `CHUNK_BYTES` of sets is taken apart into its bands'
values, dealt into chunks of at most that by a hash that differs from band to band; where a value's nodes are still not one
component, every pair of its chunks is compared. So which pairs are compared doesn't depend on a group's size, and a task
holds two chunks at most (a set larger than a chunk counts as one).

Defined cases: null text counts as empty; texts without words are copies of each other; of a component the row of the
smallest id stays (of equal ids, the smallest text hash; of equal rows, one), a null id only if there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import map_batches, materialize, partitions_for, text_hash
from cityweave.llm.simhash import BITS, SEED, keep_first, links, row_rank, stars

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Bits in which fingerprints that the trie's join links differ at most.
TRIE_BUDGET = 3
#: Nodes that a task compares with each other, at most (two chunks' in a pair of chunks).
CHUNK = 1024
#: Bytes of the sets that a chunk holds, about.
CHUNK_BYTES = 64 << 20
#: Shingles that are hashed for the bands at once.
PIECE = 1 << 13
_random = np.random.default_rng(SEED)
_MASK = _random.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_ODD = _random.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes, sorted. Words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE_WORDS:
        raw = digest(b" ".join(words), SEED)
    else:
        raw = b"".join([digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(SHINGLE_WORDS)))])
    return np.unique(np.frombuffer(raw, np.uint64))


def band_values(h: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), PIECE):
        low = np.minimum(low, ((h[None, at : at + PIECE] ^ _MASK) * _ODD).min(axis=1))
    return [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) - 2**63 for k in range(BANDS)]


def fingerprint(h: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes, as a signed long; that of no hashes is zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), PIECE):
        counts += np.unpackbits(h[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h)).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Is the Jaccard similarity of two sorted sets `least` or more?"""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-6:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-6


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: doc_id, text_key, node (hash of the set), fp (its fingerprint), bands, set_bytes."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("body"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x) for x in b.column("body").to_pylist()]
            node = pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) - 2**63 for h in sets], pa.int64())
            bands, size = pa.array([band_values(h) for h in sets], pa.list_(pa.int64())), pa.array([h.nbytes for h in sets], pa.int64())
            fp = pa.array([fingerprint(h) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), node, fp, bands, size], ["doc_id", "text_key", "node", "fp", "bands", "set_bytes"])

    return map_batches(narrow, each, "doc_id long, text_key long, node long, fp long, bands array<long>, set_bytes long")


def with_trie(nodes: DataFrame) -> DataFrame:
    """nodes (with fp, bands): bands hold one more value, the component of the node's fingerprint in the trie's self-join."""
    root = stars(links(materialize(nodes.select("fp").distinct(), "fingerprints"), TRIE_BUDGET)).select(F.col("node").alias("fp"), F.col("root").alias("to"))
    met = F.xxhash64(F.lit("trie"), F.coalesce("to", "fp"))
    return nodes.join(root, "fp", "left").withColumn("bands", F.array_append("bands", met)).drop("fp", "to")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, body (its shingle hashes) of the nodes in wanted (node, x: a row that has it)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("i"), text_hash(F.col(text_col)).alias("k"), F.col(text_col).cast("binary").alias("body"))
    met = rows.join(wanted.select("node", F.col("x.i").alias("i"), F.col("x.k").alias("k")), ["i", "k"]).select("node", "body")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(x).tobytes() for x in b.column("body").to_pylist()], pa.binary())], ["node", "body"])

    return map_batches(met, each, "node long, body binary")


def settle(members: DataFrame) -> DataFrame:
    """u, v: the links, as a forest, within each (place, first, second) of members (with node, root, bands, body).

    Nodes of one root are connected. Where bands are given, only nodes that share one of their values are compared."""

    def compare(rows: list[tuple[int, int, list[int] | None, bytes]]) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in rows}.values())
        parent, sets, found = {}, [(n, bands, np.frombuffer(b, np.uint64)) for n, _, bands, b in rows], []
        met: dict[int, list[int]] = {}

        def find(x: tuple) -> tuple:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for n, root, *_ in rows:
            parent[(n,)] = (root, None)
        for k, (n, bands, a) in enumerate(sets):
            others = range(k) if bands is None else sorted({j for v in bands for j in met.get(v, ())})
            for v in set(bands or ()):
                met.setdefault(v, []).append(k)
            for j in others:
                m, _, b = sets[j]
                x, y = find((n,)), find((m,))
                if x != y and similar(a, b):
                    parent[x] = y
                    found.append((n, m))
        return found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []
        for b in batches:
            c = [b.column(k).to_pylist() for k in ("place", "first", "second", "node", "root", "bands", "body")]
            for place, first, second, *row in zip(*c):
                if (place, first, second) != at:
                    found += compare(held)
                    at, held = (place, first, second), []
                held.append(row)
        found += compare(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

    n = partitions_for(members.sparkSession, 0, 1)
    key = ["place", "first", "second"]
    return map_batches(members.select(*key, "node", "root", "bands", "body").repartition(n, *key).sortWithinPartitions(*key), walk, "u long, v long")


def components(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, chunk: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """node, root for the nodes of marked (signatures of docs) that have a link."""
    nodes = materialize(marked.groupBy("node").agg(F.min(row_rank()).alias("x"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("set_bytes").alias("set_bytes")), "sketches")
    nodes = materialize(with_trie(nodes), "nodes")
    keyed = nodes.select("node", "set_bytes", F.explode("bands").alias("value"))
    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("set_bytes") / chunk_bytes)).cast("int").alias("parts")
    values = materialize(keyed.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("low"), chunks).where("n > 1"), "values")
    met = materialize(keyed.drop("set_bytes").join(values, "value"), "met")
    group = materialize(stars(met.select(F.col("node").alias("u"), F.col("low").alias("v"))), "groups")
    every = group.union(group.select("root", "root").distinct()).join(nodes.select("node", "bands", "set_bytes"), "node")
    size = every.groupBy("root").agg((chunks <= 1).alias("one"))
    whole = every.join(size.where("one"), "root").select(F.col("root").alias("place"), F.lit(0).alias("first"), F.lit(0).alias("second"), "node", F.col("node").alias("root"), "bands")
    large = every.join(size.where("NOT one"), "root").select("node")
    parts = F.col("parts")
    own = F.pmod(F.xxhash64("node", "value"), parts).cast("int")
    cut = materialize(met.join(large, "node").select(F.col("value").alias("place"), own.alias("own"), "parts", "node"), "cut")
    sets = materialize(shingle_sets(docs, nodes.join(every.select("node"), "node", "left_semi"), id_col, text_col), "sets")
    first = whole.union(cut.select("place", F.col("own").alias("first"), F.col("own").alias("second"), "node", F.col("node").alias("root"), F.lit(None).cast("array<long>").alias("bands")))
    found = materialize(settle(first.join(sets, "node")), "links")
    root = stars(found)
    # values of several chunks that are not one component yet: every pair of chunks
    rest = cut.where("parts > 1").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rest.groupBy("place").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("place")
    rest = rest.join(split, "place").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("own <> other")
    rest = rest.select("place", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "node", "root", F.lit(None).cast("array<long>").alias("bands"))
    if not rest.take(1):
        return root
    return stars(found.union(materialize(settle(rest.join(sets, "node")), "links")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with one row of each component."""
    marked = materialize(signatures(docs, id_col, text_col), "signatures")
    root = components(docs, marked, id_col, text_col, chunk)
    first = marked.groupBy("node").agg(F.min(row_rank()).alias("x")).join(root, "node", "left")
    kept = first.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("x").alias("x"))
    return keep_first(docs, kept, id_col, text_col)
