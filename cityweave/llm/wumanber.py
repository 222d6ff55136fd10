"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of `WINDOW` consecutive words of a benchmark item (an item with fewer words, but not none, is one
shorter pattern). For each pattern length, a table of the blocks of two words that occur in the patterns tells how far
the search may move on; a word of no pattern lets it skip a whole pattern. Where a block ends a pattern, its bucket names
the patterns that end so, told apart by their first block, and word-by-word comparison confirms an occurrence.

Words are numbers and the tables flat arrays, built once on the driver; what a block of 4 MB of benchmark costs a worker is in
the README. The tables are broadcast in blocks of items of a checked size. A larger benchmark is searched block by block over all
documents: one block at a time is held by the driver and broadcast, its findings are written, and at the end they are joined
to the documents, so the benchmark's size is not bounded.

Defined cases: null text has no words; empty benchmark: nothing is hit; items with null id or without words give no
pattern; repeated items are one; repeated documents each get a row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import discard, map_batches, materialize, text_hash

WINDOW = 10
BLOCK = 2
#: Bytes of benchmark text whose patterns are broadcast at once.
BROADCAST_BYTES = 4 << 20
#: Digits, lower-case letters and all beyond ASCII stay; A-Z become a-z; the rest separates words.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Searcher:
    """Finds all occurrences of windows of m words, in flat arrays: words are numbers, a block of two words is one long."""

    def __init__(self, texts: list[np.ndarray], owners: list[int], m: int, n_words: int):
        self.m, self.block, self.n_words = m, min(BLOCK, m), n_words
        sizes = np.array([len(t) for t in texts])
        self.flat = np.concatenate(texts)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)  # where each word's item begins
        place = np.arange(len(self.flat)) - first
        left = np.repeat(sizes, sizes) - place  # words from here to the item's end
        inside = left >= self.block
        key, end = self._keys(self.flat)[inside[: len(self.flat) - self.block + 1]], place[inside] + self.block
        # a block may end a window unless it lies in the first words of its item
        shift = np.maximum(m - end, 0)
        order = np.lexsort((shift, key))
        self.keys, at = np.unique(key[order], return_index=True)
        self.shift = shift[order][at].astype(np.int32)
        starts = np.flatnonzero(left >= m)
        every = self._keys(self.flat)
        pair = np.searchsorted(self.keys, every[starts + m - self.block]) * len(self.keys) + np.searchsorted(self.keys, every[starts])
        order = np.argsort(pair, kind="stable")
        self.pairs, self.starts, self.owner = pair[order], starts[order].astype(np.int32), np.repeat(owners, sizes)[starts][order].astype(np.int32)

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        """A long for the block that begins at each word."""
        ids = ids.astype(np.int64)
        return ids if self.block == 1 else ids[:-1] * self.n_words + ids[1:]

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, number of the item) of each occurrence in a text of word numbers, -1 for words of no item."""
        m, block = self.m, self.block
        if len(ids) < m:
            return
        known = ids[block - 1 :] >= 0
        # by how many words the search may move on where a block ends: all, or all but one, if no item has it
        step = np.where(known, m - block + 1, m)
        if block > 1:
            known = known & (ids[:-1] >= 0)
        at = np.flatnonzero(known)
        if not len(at):
            return
        key = self._keys(ids)[at]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[found] == key
        rank = np.full(len(known), -1)
        rank[at[there]] = found[there]
        step[at[there]] = self.shift[found[there]]
        steps, at, n, ends = step.tolist(), m - block, len(step), []
        while at < n:
            move = steps[at]
            if move:
                at += move
            else:
                ends.append(at)
                at += 1
        end = np.array(ends, dtype=np.int64)
        start = end - (m - block)
        here = rank[start] >= 0  # the bucket's windows are told apart by their first block
        end, start = end[here], start[here]
        pair = rank[end] * len(self.keys) + rank[start]
        lo = np.searchsorted(self.pairs, pair)
        last = np.minimum(lo, len(self.pairs) - 1)
        hit = self.pairs[last] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        start, lo, pair = start[hit], lo[hit], pair[hit]
        hi = np.searchsorted(self.pairs, pair, "right")
        for k in range(len(start)):
            here = ids[start[k] : start[k] + m]
            for w in range(lo[k], hi[k]):
                s = self.starts[w]
                if np.array_equal(self.flat[s : s + m], here):
                    yield int(start[k]), int(self.owner[w])


class Benchmark:
    """Searchers for the windows of (item_id, text) rows, one for each length. Built once, on the driver, and broadcast."""

    def __init__(self, rows: Iterable[tuple[str, bytes | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.items: list[str] = []
        by_length: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for item, text in rows:
            w = words_of(text)
            if item is not None and w:
                texts, owners = by_length[min(len(w), window)]
                texts.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], dtype=np.int32))
                owners.append(len(self.items))
                self.items.append(item)
        self.parts = [Searcher(texts, owners, m, len(self.number)) for m, (texts, owners) in sorted(by_length.items())]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of hit words, items with an occurring window)."""
        spans, items = set(), set()
        ids = self.numbers(words) if self.parts else None
        for searcher in self.parts:
            for start, item in searcher.find(ids):
                spans.add((start, start + searcher.m))
                items.add(self.items[item])
        return sorted(spans), items


def count_hit(spans: Iterable[tuple[int, int]]) -> int:
    n, reach = 0, 0
    for a, b in sorted(spans):
        n += max(0, b - max(a, reach))
        reach = max(reach, b)
    return n


SCHEMA = "doc_id long, text_key long, n_words long, spans array<long>, items array<string>"


def scan(docs: DataFrame, held: Broadcast) -> DataFrame:
    """One row per row of docs (doc_id, text_key, body): its words, hit spans (start << 32 | end) and items."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = held.value
        for b in batches:
            out = []
            for t in b.column("body").to_pylist():
                w = words_of(t)
                spans, found = bench.hits(w)
                out.append((len(w), [a << 32 | e for a, e in spans], sorted(found)))
            arrays = [b.column("doc_id"), b.column("text_key"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_words", "spans", "items"])

    return map_batches(docs, each, SCHEMA)


class ItemBlocks:
    """The benchmark's (item, text) rows in blocks of about most_bytes at most, fetched one at a time."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int):
        self.rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).distinct()
        size = self.rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        self.n = -(-int(size) // most_bytes) or 1

    def broadcast(self, k: int, window: int) -> Broadcast:
        """The tables of a block. A worker reads them once and keeps them from task to task."""
        part = self.rows if self.n == 1 else self.rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n)) == k)
        return self.rows.sparkSession.sparkContext.broadcast(Benchmark(sorted((r.item, bytes(r.text)) for r in part.toLocalIterator()), window))


def findings(narrow: DataFrame, blocks: ItemBlocks, window: int) -> DataFrame:
    """scan() of all blocks. Rows of one id and text have the same findings, so those are kept once and joined by them."""
    if blocks.n == 1:
        return scan(narrow, blocks.broadcast(0, window))
    hits = None
    for k in range(blocks.n):
        held = blocks.broadcast(k, window)
        found = scan(narrow, held)
        once = found.where(F.size("spans") > 0).groupBy("doc_id", "text_key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        once = materialize(once, "hits")
        held.destroy()
        hits = once if hits is None else hits.union(once)
    # as many lists for a key as there are blocks
    merged = hits.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = merged.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "spans", "items")
    rows = scan(narrow, narrow.sparkSession.sparkContext.broadcast(Benchmark([], window))).select("doc_id", "text_key", "n_words")
    joined = rows.join(merged, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    return joined.select("doc_id", "text_key", "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, and hit_spans (start << 32 | end, in words)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("body"))
    found = findings(narrow, ItemBlocks(benchmark, item_col, item_text_col, broadcast_bytes), window)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[(s >> 32, s & 0xFFFFFFFF) for s in x] for x in b.column("spans").to_pylist()]
            items, hit = b.column("items").to_pylist(), [count_hit(s) for s in spans]
            arrays = [
                *(b.column(k) for k in ("doc_id", "text_key", "n_words")), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), b.column("spans"),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    return map_batches(found, each, "doc_id long, text_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<long>")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; each block of the benchmark filters what the last one left.

    Null and empty texts stay, repeated rows stay as often as they occur, an empty benchmark takes nothing out; columns of
    docs may have any names."""
    out, columns, blocks = docs, docs.columns, ItemBlocks(benchmark, item_col, item_text_col, broadcast_bytes)
    for k in range(blocks.n):
        held = blocks.broadcast(k, window)

        def each(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for b in batches:
                ok = [not bench.hits(words_of(None if t is None else t.encode()))[0] for t in b.column(text_col).to_pylist()]
                yield b.filter(pa.array(ok, pa.bool_())).select(columns)

        left = map_batches(out, each, docs.schema)
        if k + 1 < blocks.n:
            previous, left = out, materialize(left, "clean")
            held.destroy()
            if k:
                discard(previous)
        out = left
    return out
