"""Repeated-substring removal by super-k-mer partitioning.

Every window of `WINDOW` consecutive words whose word sequence also starts earlier (smaller doc_id, or the same document
further left) is a repeat, and the words it covers are removed. Windows are judged on the input.

Method: a window's minimiser is the least hash among its `SEED_WORDS`-word pieces. Consecutive windows that share a
minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket, so equal windows meet in one bucket
whatever surrounds them. A bucket numbers its words, sorts its windows and compares equal neighbours word by word, so
hashes decide nothing by themselves.

Skew: a task sends each distinct super-k-mer once, with its earliest place; the later places it saw are repeats already
and travel as finished spans, dealt out by document. A bucket therefore gets a hot passage at most once from each task
flush, however many documents hold it. Packed strings of one bucket are compressed together. Buckets are processed one
at a time within a partition, and their number follows the size of the input. Windows of a minimiser so frequent that its
bucket would be too large take a second one among their longer pieces, which spreads them over many buckets.

Defined cases: null text has no words; texts shorter than a window lose nothing; rows with equal doc_id and equal text
are one document that is returned as often as it occurs; rows with equal doc_id and other text are ordered by a hash of
their text; a null doc_id comes after every other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import NULL_ID, free_names, map_batches, partitions_for, text_hash

WINDOW = 20
SEED_WORDS, LONG_SEED_WORDS = 4, 12
#: Bytes of packed strings that a task holds before it sends them.
FLUSH_BYTES = 48 << 20
#: Bytes of text whose super-k-mers make up about one bucket, and of those a shuffle partition holds.
BUCKET_TEXT = 4 << 20
PARTITION_TEXT = 8 << 20
#: Bytes of text in which frequent minimisers are looked for, and how often one must be there to be dealt out further.
SAMPLE_TEXT, SAMPLE_LEAST, MOST_HOT = 32 << 20, 64, 100_000
SPAN = -1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all `width` consecutive elements of h (uint64), one for each start."""
    out, have, power, size = None, 0, mix(h), 1
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = power[: len(h) - size + 1] if out is None else out[: len(h) - have - size + 1] * np.uint64(0xD6E8FEB86659FD93) + power[have : len(h) - size + 1]
                have += size
            left >>= 1
            if left:
                power = mix(power[: len(power) - size] * np.uint64(0xA0761D6478BD642F) + power[size:])
                size *= 2
        return mix(out)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of all `width` consecutive elements of x, one for each start."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def super_kmers(words: list[bytes], starts: np.ndarray, window: int = WINDOW, seed: int = SEED_WORDS, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of each super-k-mer of the documents that begin at `starts` in words.

    Windows whose minimiser is one of `hot` (sorted) take another, among their pieces of `LONG_SEED_WORDS` words."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    low = window_min(window_hash(h, seed), window - seed + 1)
    if hot is not None and len(hot):
        dealt = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
        if dealt.any():
            long = min(LONG_SEED_WORDS, window)
            with np.errstate(over="ignore"):
                low = np.where(dealt, mix(low ^ window_min(window_hash(h, long), window - long + 1)), low)
    doc = np.searchsorted(starts, np.arange(len(low)), "right")
    whole = doc == np.searchsorted(starts, np.arange(window - 1, n), "right")
    cut = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])))
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(low)))
    ok = whole[first]
    return first[ok], count[ok], low[first[ok]]


def merge_spans(ids: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of equal (id, key) that touch or overlap, joined."""
    if not len(ids):
        return ids, keys, lo, hi
    o = np.lexsort((lo, keys, ids))
    ids, keys, lo, hi = ids[o], keys[o], lo[o], hi[o]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
    group = np.cumsum(new)
    reach = np.maximum.accumulate(hi + group * np.int64(1 << 40)) - group * np.int64(1 << 40)
    cut = np.flatnonzero(new | np.concatenate(([True], lo[1:] > reach[:-1])))
    return ids[cut], keys[cut], lo[cut], np.maximum.reduceat(hi, cut)


SCHEMA = "bucket long, id binary, key binary, lo binary, hi binary, body binary"
NAMES = ["bucket", "id", "key", "lo", "hi", "body"]


LEVEL = 3


def packed_row(bucket: int, ids, keys, lo, hi, codec: zstandard.ZstdCompressor, body: bytes = b"") -> tuple:
    """A row to send: ids as differences, all but the keys (hashes) compressed."""
    small = lambda a: codec.compress(a.tobytes())
    return bucket, small(np.diff(np.asarray(ids, np.int64), prepend=0)), np.asarray(keys, np.int64).tobytes(), small(np.asarray(lo, np.int32)), small(np.asarray(hi, np.int32)), body and codec.compress(body)


def unpacked_row(row: tuple, codec: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, lo, hi) of a row."""
    lo, hi = (np.frombuffer(codec.decompress(row[k]), np.int32).astype(np.int64) for k in (3, 4))
    return np.cumsum(np.frombuffer(codec.decompress(row[1]), np.int64)), np.frombuffer(row[2], np.int64), lo, hi


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)


def pack(batches: Iterator[pa.RecordBatch], n_buckets: int, window: int, flush_bytes: int, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Documents (id, key, body) to packed rows: super-k-mers for their buckets, and spans that are known to repeat."""
    codec = zstandard.ZstdCompressor(level=LEVEL)
    seen: dict[bytes, tuple[int, int, int, int]] = {}
    spans: list[tuple[int, int, int, int]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seen, spans, held
        if spans:
            s = merge_spans(*(np.array(x, np.int64) for x in zip(*spans)))
            cuts = np.array_split(np.arange(len(s[0])), min(16, len(s[0])))
            yield rows_batch([packed_row(SPAN - int(s[0][c[0]]) % 4096, *(x[c] for x in s), codec) for c in cuts])
        by: dict[int, list[tuple[bytes, tuple[int, int, int, int]]]] = {}
        for item in seen.items():
            by.setdefault(item[1][3], []).append(item)
        rows, size = [], 0
        for bucket, items in by.items():
            texts, places = zip(*items)
            ids, keys, lo, _ = zip(*places)
            rows.append(packed_row(bucket, ids, keys, lo, [], codec, b"\n".join(texts)))
            size += len(rows[-1][5])
            if len(rows) >= 512 or size > 4 << 20:
                yield rows_batch(rows)
                rows, size = [], 0
        if rows:
            yield rows_batch(rows)
        seen, spans, held = {}, [], 0

    for b in batches:
        words: list[bytes] = []
        starts, owner = [], []
        for i, k, t in zip(b.column("id").to_pylist(), b.column("key").to_pylist(), b.column("body").to_pylist()):
            w = (t or b"").split()
            if len(w) >= window:
                starts.append(len(words))
                owner.append((i, k))
                words += w
        if not words:
            continue
        starts = np.array(starts)
        first, count, low = super_kmers(words, starts, window, hot=hot)
        doc = np.searchsorted(starts, first, "right") - 1
        bucket = (mix(low) % np.uint64(n_buckets)).astype(np.int64)
        for at, n, d, to, s in zip(first.tolist(), count.tolist(), doc.tolist(), bucket.tolist(), (first - starts[doc]).tolist()):
            text = b" ".join(words[at : at + n + window - 1])
            place = (*owner[d], s, to)
            old = seen.get(text)
            if old is None:
                seen[text] = place
                held += len(text) + 200
            elif old[:3] != place[:3]:
                if place[:3] < old[:3]:
                    seen[text], place = place, old
                spans.append((place[0], place[1], place[2], place[2] + n + window - 1))
        if held + 64 * len(spans) > flush_bytes:
            yield from flush()
    yield from flush()


def bucket_repeats(texts: list[bytes], ids: np.ndarray, keys: np.ndarray, lo: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Spans (id, key, first word, end) of the windows in a bucket's super-k-mers that also start earlier."""
    split = [t.split(b" ") for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = np.empty(int(sizes.sum()), object)
    words[:] = [w for s in split for w in s]
    code = pd.factorize(words)[0]
    del words, split
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = sizes - window + 1
    string = np.repeat(np.arange(len(n)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begin[string] + step
    h = window_hash(code.astype(np.uint64) + np.uint64(1), window)[at]
    place = np.lexsort((keys, ids))
    rank = np.empty(len(ids), np.int64)
    rank[place] = np.cumsum(np.concatenate(([0], (ids[place][1:] != ids[place][:-1]) | (keys[place][1:] != keys[place][:-1]))))
    order_key = (rank[string] << np.int64(32)) + lo[string] + step
    o = np.lexsort((order_key, h))
    new = np.concatenate(([True], h[o][1:] != h[o][:-1]))
    head = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
    rest = np.flatnonzero(o != head)
    covered = np.zeros(len(at), bool)
    shift = np.arange(window)
    false = []
    for k in range(0, len(rest), 1 << 18):
        a, b = o[rest[k : k + (1 << 18)]], head[rest[k : k + (1 << 18)]]
        equal = (code[at[a][:, None] + shift] == code[at[b][:, None] + shift]).all(1)
        covered[a[equal]] = order_key[a[equal]] > order_key[b[equal]]
        false.append(a[~equal])
    if any(map(len, false)):  # windows that differ under one hash: settle those hashes by the words themselves
        bad = np.isin(h, h[np.concatenate(false)])
        least: dict[bytes, int] = {}
        for a in o[bad[o]]:
            w = code[at[a] : at[a] + window].tobytes()
            covered[a] = order_key[a] > least.setdefault(w, order_key[a])
    edge = np.concatenate(([True], (string[1:] != string[:-1]) | (covered[1:] != covered[:-1]))) if len(string) else np.zeros(0, bool)
    run = np.flatnonzero(edge)
    length = np.diff(np.append(run, len(string)))
    run, length = run[covered[run]], length[covered[run]]
    s = string[run]
    begin_word = lo[s] + step[run]
    return ids[s], keys[s], begin_word, begin_word + length + window - 1


def unpack(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Packed rows, sorted by bucket, to spans id, key, span (first word << 32 | end)."""
    codec = zstandard.ZstdDecompressor()

    def out(ids, keys, lo, hi) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array((lo.astype(np.int64) << np.int64(32)) | hi.astype(np.int64))], ["id", "key", "span"])

    def done(rows: list[tuple]) -> pa.RecordBatch:
        texts = [t for r in rows for t in codec.decompress(r[5]).split(b"\n")]
        ids, keys, lo, _ = (np.concatenate(x) for x in zip(*(unpacked_row(r, codec) for r in rows)))
        return out(*merge_spans(*bucket_repeats(texts, ids, keys, lo, window)))

    now, rows = None, []
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in NAMES)):
            if r[0] <= SPAN:
                yield out(*unpacked_row(r, codec))
                continue
            if r[0] != now and rows:
                yield done(rows)
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield done(rows)


def hot_minimisers(docs: DataFrame, n_bytes: int, window: int, bucket_text: int = BUCKET_TEXT) -> np.ndarray:
    """Minimisers whose windows hold more text than a bucket should, sorted. Found in a sample of whole documents, as range
    partitioning finds its bounds: they only decide how windows are dealt out, whatever they are the result is the same."""
    share = min(1.0, SAMPLE_TEXT / max(n_bytes, 1))
    rows = docs if share == 1 else docs.sample(share, 7)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [w for t in b.column("body").to_pylist() if len(w := (t or b"").split()) >= window]
            if split:
                starts = np.cumsum([0, *map(len, split[:-1])])
                first, count, low = super_kmers([w for x in split for w in x], starts, window)
                value, at = np.unique(low, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.bincount(at, count).astype(np.int64))], ["low", "n"])

    words = max(1, bucket_text // 6)  # a word takes about six bytes
    least = max(SAMPLE_LEAST, int(words * share))
    t = map_batches(rows, each, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "low").limit(MOST_HOT).toArrow()
    return np.sort(t.column("low").to_numpy().astype(np.int64).view(np.uint64))


def repeat_spans(docs: DataFrame, window: int = WINDOW, n_buckets: int | None = None, flush_bytes: int = FLUSH_BYTES, bucket_text: int = BUCKET_TEXT) -> DataFrame:
    """id, key, span of repeated passages; docs has id, key, body."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_buckets = n_buckets or partitions_for(spark, n_bytes, bucket_text)
    hot = spark.sparkContext.broadcast(hot_minimisers(docs, n_bytes, window, bucket_text))
    packed = map_batches(docs, lambda it: pack(it, n_buckets, window, flush_bytes, hot.value), SCHEMA)
    dealt = packed.repartition(partitions_for(spark, n_bytes, PARTITION_TEXT), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda it: unpack(it, window), "id long, key long, span long")


def covered_words(n: int, spans: np.ndarray) -> np.ndarray:
    """Mask of the words that spans (first word << 32 | end) cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, spans >> 32, 1)
    np.add.at(d, spans & 0xFFFFFFFF, -1)
    return np.cumsum(d[:-1]) > 0


def with_spans(docs: DataFrame, id_col: str, text_col: str, window: int, **options) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the repeated passages (array of longs, null where nothing repeats)."""
    id_, key, spans = free_names(docs, "span_id", "span_key", "spans")
    marked = docs.withColumn(id_, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(key, text_hash(F.col(text_col)))
    found = repeat_spans(marked.select(F.col(id_).alias("id"), F.col(key).alias("key"), F.col(text_col).cast("binary").alias("body")), window, **options)
    by_doc = found.groupBy(F.col("id").alias(id_), F.col("key").alias(key)).agg(F.collect_list("span").alias(spans))
    return marked.join(by_doc, [id_, key], "left").select(*docs.columns, spans), spans


def kept_text(text: bytes | None, spans: list[int] | None) -> tuple[bytes, int, int]:
    """(kept words joined by one space, words, removed words)."""
    words = (text or b"").split()
    if not spans:
        return b" ".join(words), len(words), 0
    gone = covered_words(len(words), np.array(spans, np.int64))
    return b" ".join([words[k] for k in np.flatnonzero(~gone)]), len(words), int(gone.sum())


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked, spans = with_spans(source, "doc_id", "text", window, **options)
    marked = marked.withColumn("text", F.col("text").cast("binary"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_text(t, s) for t, s in zip(b.column("text").to_pylist(), b.column(spans).to_pylist())]
            arrays = [b.column("doc_id"), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_batches(marked, each, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """docs with repeated passages taken out of the text; a text that loses nothing stays byte for byte."""
    (marked, spans), columns = with_spans(docs, id_col, text_col, window, **options), docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            new = [t if t is None or not s else kept_text(t.encode(), s)[0].decode() for t, s in zip(texts, b.column(spans).to_pylist())]
            yield b.set_column(at, text_col, pa.array(new, b.schema.field(at).type)).select(columns)

    return map_batches(marked, each, docs.schema)
