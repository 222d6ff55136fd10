"""Brown class-based bigram scoring of whole texts.

Words are grouped into classes by exchange clustering: every item moves to the class that raises the mutual information
of adjacent classes most, until few move. A text's probability is the product of class transitions and of the emission
of each word by its class, both smoothed; an end token closes each text and is the context of the next one's first word.

Counts cover all training texts. Words are counted per task, summed per word, and kept in a table that grows with the
corpus. Clustering works on a bounded set of items: the `WORD_ITEMS` most frequent words, and the `ENDING_ITEMS` most
frequent endings of all others (their last `ENDING_BYTES` bytes); a word outside the frequent ones takes the class of its
ending, other endings are one item. The pairs of items that the driver clusters are at most their number squared. Counts of the frequent words (at most `COMMON` of them) are
broadcast; the rarer words of a text are joined with the table of counts, so no vocabulary is held whole anywhere.

Defined cases: null text is empty and scores its end token; without training texts every word is unknown and classes
don't matter; repeated rows each get a row and count as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import held_out, map_batches, materialize

#: The end token; no word is empty.
END = b""
CLASSES = 48
#: Clustered words and word endings.
WORD_ITEMS, ENDING_ITEMS = 3000, 1000
ENDING_BYTES = 3
ROUNDS = 6
#: Tokens whose pairs a task adds up before it hands them on, at most (its counts have 32 bits).
MOST_TOKENS = 1 << 30
#: Words whose counts are broadcast, at most.
COMMON = 100_000
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000
ALPHA = 0.5


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space, then the end token."""
    w = (text or b"").lower().split()
    w.append(END)
    return w


def word_counts(train: DataFrame) -> DataFrame:
    """word, c over all rows of train (column body), the end token included."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words, counts = list(seen), list(seen.values())
            for k in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + (1 << 16)], pa.binary()), pa.array(counts[k : k + (1 << 16)], pa.int64())], ["word", "c"])
            seen.clear()

        for b in batches:
            for t in b.column("body").to_pylist():
                seen.update(tokens(t))
            if len(seen) > FLUSH:
                yield from flush()
        yield from flush()

    return map_batches(train, each, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of the largest counts, most frequent first: all with at least some count, chosen so that they are `most` at most."""
    levels = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    total, least = 0, None
    for r in sorted(levels, key=lambda r: -r.level):
        total += r.n
        if total > most:
            break
        least = r.c
    if least is None:
        return []
    t = counts.where(F.col("c") >= least).toArrow()
    return sorted(zip(t.column("word").to_pylist(), t.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))


class Items:
    """Numbers of the clustered items: 0 the end token, 1 any other ending, then frequent words, then endings."""

    def __init__(self, words: list[bytes], endings: list[bytes]):
        self.word = {END: 0} | {w: k + 2 for k, w in enumerate(words)}
        self.ending = {e: k + 2 + len(words) for k, e in enumerate(endings)}
        self.n = 2 + len(words) + len(endings)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get, ending = self.word.get, self.ending.get
        return np.fromiter((k if (k := get(w)) is not None else ending(w[-ENDING_BYTES:], 1) for w in words), np.int64, len(words))


class Pairs(NamedTuple):
    """How often item row[k] is followed by item col[k]: count[k]; n items."""

    n: int
    row: np.ndarray
    col: np.ndarray
    count: np.ndarray

    @classmethod
    def dense(cls, matrix: np.ndarray) -> Pairs:
        row, col = np.nonzero(matrix)
        return cls(len(matrix), row, col, matrix[row, col].astype(np.int64))

    def by_class(self, of: np.ndarray, classes: int) -> np.ndarray:
        """Class by class counts."""
        return np.bincount(of[self.row] * classes + of[self.col], self.count, classes * classes).reshape(classes, classes)


def item_pairs(train: DataFrame, items: Items) -> Pairs:
    """Pairs over all rows of train (column body); at most items.n squared of them come back."""
    held = train.sparkSession.sparkContext.broadcast(items)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = held.value
        total = np.zeros(it.n * it.n, np.int32)

        def flush() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            out = pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["pair", "n"])
            total[at] = 0
            return out

        seen = 0
        for b in batches:
            for t in b.column("body").to_pylist():
                k = it.numbers(tokens(t))
                for c in range(0, len(k), MOST_TOKENS):
                    if seen >= MOST_TOKENS:
                        yield flush()
                        seen = 0
                    part = k[c : c + MOST_TOKENS]
                    np.add.at(total, np.concatenate((k[c - 1 : c] if c else [0], part[:-1])) * it.n + part, 1)
                    seen += len(part)
        yield flush()

    t = map_batches(train, each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    row, col = np.divmod(t.column("pair").to_numpy(), items.n)
    return Pairs(items.n, row.astype(np.int32), col.astype(np.int32), t.column("n").to_numpy())


def exchange(pairs: Pairs, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item; item 0 (the end token) has class 0 to itself."""
    n = pairs.n
    f = lambda x: x * np.log(np.maximum(x, 1))
    total = np.bincount(pairs.row, pairs.count, n) + np.bincount(pairs.col, pairs.count, n)
    order = np.argsort(-total[1:], kind="stable") + 1
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    right = np.bincount(pairs.row.astype(np.int64) * classes + of[pairs.col], pairs.count, n * classes).reshape(n, classes)  # what follows an item
    left = np.bincount(pairs.col.astype(np.int64) * classes + of[pairs.row], pairs.count, n * classes).reshape(n, classes)  # what precedes it
    grid = pairs.by_class(of, classes)
    self_count = np.zeros(n)
    same = pairs.row == pairs.col
    self_count[pairs.row[same]] = pairs.count[same]
    by_row, by_col = np.argsort(pairs.row, kind="stable"), np.argsort(pairs.col, kind="stable")
    row_at, col_at = (np.searchsorted(x, np.arange(n + 1)) for x in (pairs.row[by_row], pairs.col[by_col]))
    after, after_n = pairs.col[by_row], pairs.count[by_row]
    before, before_n = pairs.row[by_col], pairs.count[by_col]
    for _ in range(rounds):
        moved = 0
        for x in order:
            own, self_n = of[x], float(self_count[x])
            r, l = right[x].copy(), left[x].copy()  # noqa: E741
            r[own] -= self_n
            l[own] -= self_n
            grid[own, :] -= r
            grid[:, own] -= l
            grid[own, own] -= self_n
            # gain of adding x to each class: rows, columns, the corner that both touch, and the class totals
            base = f(grid)
            row = (f(grid + r[None, :]) - base).sum(1)
            col = (f(grid + l[:, None]) - base).sum(0)
            d = np.diagonal(grid)
            corner = f(d + r + l + self_n) - f(d) - (f(d + r) - f(d)) - (f(d + l) - f(d))
            row_sum, col_sum = grid.sum(1) + l, grid.sum(0) + r  # of all classes, x in no class but next to its neighbours
            a, b = r.sum() + self_n, l.sum() + self_n
            gain = row + col + corner - (f(row_sum + a) - f(row_sum)) - (f(col_sum + b) - f(col_sum))
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[own] + 1e-9:
                new = own
            grid[new, :] += r
            grid[:, new] += l
            grid[new, new] += self_n
            if new != own:
                of[x] = new
                moved += 1
                i, k = before[col_at[x] : col_at[x + 1]], before_n[col_at[x] : col_at[x + 1]]
                right[i, own] -= k
                right[i, new] += k
                i, k = after[row_at[x] : row_at[x + 1]], after_n[row_at[x] : row_at[x + 1]]
                left[i, own] -= k
                left[i, new] += k
        if moved <= n // 100:
            break
    return of


class Model:
    """What scoring needs, of bounded size."""

    def __init__(self, items: Items, of: np.ndarray, pairs: Pairs, class_tokens: np.ndarray, class_types: np.ndarray, n: int, v: int, common: dict[bytes, int]):
        c = len(class_tokens)
        grid = pairs.by_class(of, c)
        unigram = (grid.sum(0) + 1) / (grid.sum() + c)
        seen = (grid > 0).sum(1)
        row = grid.sum(1)
        weight = row / (row + seen + 1)  # Witten-Bell
        self.transition = np.log10(weight[:, None] * grid / np.maximum(row, 1)[:, None] + (1 - weight)[:, None] * unigram[None, :])
        self.emission = -np.log10(class_tokens + ALPHA * (class_types + 1))
        self.items, self.of, self.n, self.v, self.common = items, of, n, v, {w: math.log10(k + ALPHA) for w, k in common.items()}


def fit(train: DataFrame, counts: DataFrame, classes: int = CLASSES, word_items: int = WORD_ITEMS, ending_items: int = ENDING_ITEMS, most_common: int = COMMON) -> Model:
    spark = train.sparkSession
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = [(w, c) for w, c in common_words(counts, most_common)]
    words = [w for w, _ in common if w != END][:word_items]
    frequent = spark.createDataFrame([(w,) for w in [END, *words]], "word binary")  # `word_items` rows
    others = counts.join(F.broadcast(frequent), "word", "left_anti")
    endings = others.groupBy(F.expr(f"substring(word, -{ENDING_BYTES}, {ENDING_BYTES})").alias("ending")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(ending_items)
    items = Items(words, [bytes(r.ending) for r in endings.collect()])
    pairs = item_pairs(train, items)
    of = exchange(pairs, classes)
    held = spark.sparkContext.broadcast((items, of))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, cls = held.value
        tok, typ = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for b in batches:
            k = cls[it.numbers(b.column("word").to_pylist())]
            tok += np.bincount(k, b.column("c").to_numpy(), classes).astype(np.int64)
            typ += np.bincount(k, minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(tok), pa.array(typ)], ["cls", "tokens", "types"])

    tok, typ = np.zeros(classes), np.zeros(classes)
    for r in counts.mapInArrow(sums, "cls long, tokens long, types long").groupBy("cls").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect():
        tok[r.cls], typ[r.cls] = r.tokens, r.types
    return Model(items, of, pairs, tok, typ, int(n), int(v), dict(common))


PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, sum_log double, class_log double, rare array<struct<word:binary,tf:long>>"


def partial_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, held_out, body) all that the broadcast model gives, and the words that it lacks."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, row = held.value, TaskContext.get().partitionId() << 40
        get, rare_kind = m.common.get, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
        for b in batches:
            out = []
            for t in b.column("body").to_pylist():
                w = tokens(t)
                c = m.of[m.items.numbers(w)]
                log = m.transition[np.concatenate(([0], c[:-1])), c].sum() + m.emission[c].sum()
                known = [get(x) for x in w]
                rare = Counter([x for x, k in zip(w, known) if k is None])
                known = [k for k in known if k is not None]
                out.append((row, len(w), len(known), math.fsum(known), float(log), [{"word": x, "tf": k} for x, k in rare.items()]))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out]), b.column("doc_id"), b.column("held_out"), pa.array([x[1] for x in out]), pa.array([x[2] for x in out]), pa.array([x[3] for x in out]), pa.array([x[4] for x in out]), pa.array([x[5] for x in out], rare_kind)],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "sum_log", "class_log", "rare"],
            )

    return map_batches(docs, each, PARTS)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remainder: int = 1, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of the model, per token)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), remainder).alias("held_out"), F.col(text_col).cast("binary").alias("body"))
    train = source.where("not held_out").select("body")
    counts = materialize(word_counts(train), "word-counts")
    model = fit(train, counts, **options)
    parts = materialize(partial_scores(source, model), "partial-scores")
    rare = parts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.tf")
    seen = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    sums = F.col("sum_log") + F.coalesce("rare_log", F.lit(0.0))
    whole = model.n + ALPHA * (model.v + 1)
    scored = parts.drop("rare").join(seen, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (sums - F.col("n_tokens") * math.log10(whole)).alias("base_score"), (sums + F.col("class_log")).alias("score"),
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
