"""Document quality by counted rules and boosted trees over document statistics.

Each whole text gives counts; hard rules on them fail a document outright, and a small forest of boosted trees, trained
on quality labels, judges the others. The forest may not reward symbols, repetition, duplicate lines or shouting: these
features are constrained to lower the score or leave it.

Bounds: training reads the statistics of at most `TRAIN_ROWS` labelled documents (those of the smallest hash of their
id) of at most `TRAIN_BYTES` together. Scoring is one pass over all documents without a shuffle.

Defined cases: null and empty texts have no words and fail the rules; without labels of both kinds all that pass the
rules are kept; repeated labels of one id count once, the largest; of documents of one labelled id one trains, that of the
smallest text hash; repeated documents each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import map_batches, training_rows
from cityweave.llm.boosting import Forest, train

TRAIN_ROWS, TRAIN_BYTES = 20_000, 256 << 20
MIN_WORDS = 50
SYMBOL = re.compile(r"[#*$%&|<>]")
SPACES = " \t\n\x0b\x0c\r"
#: Feature and the direction in which the score may go with it.
FEATURES = [("mean_word_chars", 0), ("symbols_per_word", -1), ("duplicate_line_share", -1), ("repeat_word_share", -1), ("distinct_word_share", 0), ("upper_share", -1), ("mark_share", -1), ("digit_share", 0), ("words_per_line", 0), ("log_words", 0)]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    t = text or ""
    w = t.encode().split()
    n = len(w)
    chars = len(t) - sum(map(t.count, SPACES))
    symbols = len(SYMBOL.findall(t))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n >= 3:
        grams = list(zip(w, w[1:], w[2:]))
        again, once = set(), set()
        for g in grams:
            (again if g in once else once).add(g)
        if again:
            reach = 0
            for k, g in enumerate(grams):
                if g in again:
                    repeat += k + 3 - max(k, reach)
                    reach = k + 3
    return n, chars, symbols, dup, repeat


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The counts of a text and its features."""
    c = n, chars, symbols, dup, repeat = counts(text)
    t = text or ""
    m, lines = max(n, 1), max(1, t.count("\n") + 1)
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", t))
    marks, digits = t.count("!") + t.count("|") + t.count("?"), len(re.findall(r"[0-9]", t))
    distinct = len(set(t.lower().split()))
    return c, [chars / m, symbols / m, dup / lines, repeat / m, distinct / m, upper / max(chars, 1), marks / m, digits / max(chars, 1), n / lines, float(np.log1p(n))]


def fails(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = TRAIN_ROWS) -> Forest:
    rows = training_rows(docs, labels, most_rows, TRAIN_BYTES, id_col, text_col, label_col, "rules-train")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t) for t in b.column("text").to_pylist()]
            keep = pa.array([not fails(c[0], c[4]) for c, _ in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([f for _, f in got], pa.list_(pa.float64()))], ["y", "x"]).filter(keep)

    t = map_batches(rows, each, "y int, x array<double>").toArrow()
    x = np.array(t.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return train(x, t.column("y").to_numpy().astype(float), [d for _, d in FEATURES])


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, kept, quality (the forest's probability)."""
    held = docs.sparkSession.sparkContext.broadcast(forest)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t) for t in b.column("text").to_pylist()]
            p = held.value.probability(np.array([f for _, f in got], float).reshape(-1, len(FEATURES)))
            bad = [fails(c[0], c[4]) for c, _ in got]
            cols = [pa.array([c[k] for c, _ in got], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(bad, pa.bool_()), pa.array([not f and q >= threshold for f, q in zip(bad, p.tolist())], pa.bool_()), pa.array(p)], ["doc_id", *NAMES, "base_failed", "kept", "quality"])

    return map_batches(source, each, f"doc_id long, {STATS}, base_failed boolean, kept boolean, quality double")
