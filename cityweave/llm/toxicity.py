"""Toxicity by multiple-instance learning.

Only documents carry labels, and a toxic document is one with at least one toxic sentence. Each sentence gets
a probability from a logistic model over its words and word beginnings; a document's score is their noisy-or,
1 - prod(1 - p). The sentence model is trained through the noisy-or on document labels alone, and then names the
sentences that make a document toxic. Words that are harmless once and toxic when they recur make the noisy-or too
cautious, so a logistic curve fitted on the same labels maps its log-odds to the score; the order of scores stays.

Bounds: training reads at most `TRAIN_ROWS` labelled documents (those of the smallest hash of their id) of at most
`TRAIN_BYTES` together, keeps at most `FEATURES` features, and broadcasts these. Scoring is one pass over all documents without a shuffle.

Defined cases: null and empty texts have one empty sentence; without labels of both kinds every document scores the
labels' mean (0.5 without labels); repeated labels of one id count once, the largest; of documents of one labelled id one
trains, that of the smallest text hash; repeated documents each get a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import held_out, map_batches, training_rows

TRAIN_ROWS, TRAIN_BYTES = 20_000, 256 << 20
FEATURES = 512
MIN_DOCS = 4
#: Log-likelihood ratio from which a feature tells labels apart.
MIN_RATIO = 20.0
BEGINNINGS = range(3, 9)
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
STEPS, RATE, DECAY = 400, 0.1, 2e-4
MEMO = 300_000


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in BEGINNINGS if n <= len(word))]


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence with a word, in characters."""
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m[0].lower()))
        if words:
            yield m.start(), m.end(), words


def log_odds(s: np.ndarray | float) -> np.ndarray | float:
    """Log-odds of 1 - exp(-s), for s the sum of -log(1 - p) over sentences."""
    s = np.clip(s, 1e-9, 30)
    return np.log(np.expm1(s))


class SentenceModel:
    def __init__(self, weights: dict[str, float], bias: float, curve: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.bias, self.curve, self.memo = weights, bias, curve, {}

    def word(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            get = self.weights.get
            got = sum(get(f, 0.0) for f in features(w))
            if len(self.memo) < MEMO:
                self.memo[w] = got
        return got

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(calibrated noisy-or of the sentences, (start, end, probability) of each sentence)."""
        word = self.word
        z = [(a, b, self.bias + sum(map(word, ws))) for a, b, ws in sentences(text)] or [(0, 0, self.bias)]
        logits = np.array([x[2] for x in z])
        p = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
        doc = self.curve[0] * log_odds(np.logaddexp(0, logits).sum()) + self.curve[1]
        return float(1 / (1 + np.exp(-np.clip(doc, -40, 40)))), [(a, b, q) for (a, b, _), q in zip(z, p.tolist())]


def select_features(rows: DataFrame, n: int, n_toxic: int, most: int) -> list[str]:
    """The features whose presence depends most on the label, by log-likelihood ratio."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(seen[k]), pa.string()), pa.array(list(seen[k].values()) if k else [0] * len(seen[k]), pa.int64()), pa.array(list(seen[k].values()), pa.int64())], ["feature", "toxic", "docs"])
                seen[k].clear()

        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = set().union(*(ws for _, _, ws in sentences(t)))
                seen[1 if y else 0].update({f for w in words for f in features(w)})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from flush()
        yield from flush()

    c = map_batches(rows, each, "feature string, toxic long, docs long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("docs").alias("m")).where(F.col("m") >= MIN_DOCS)
    a, m = F.col("a"), F.col("m")
    term = lambda o, e: F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0)
    clean = n - n_toxic
    ratio = term(a, m * n_toxic / n) + term(m - a, m * clean / n) + term(n_toxic - a, (n - m) * n_toxic / n) + term(clean - (m - a), (n - m) * clean / n)
    return [r.feature for r in c.withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("ratio"), "feature").limit(most).collect()]


def bags(rows: DataFrame, names: list[str]) -> pa.Table:
    """Per training row: y, its number of sentences, and the features of those that have some (-1 ends a sentence)."""
    at = {f: k for k, f in enumerate(names)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                n, flat = 0, []
                for _, _, ws in sentences(t):
                    n += 1
                    have = [at[f] for w in ws for f in features(w) if f in at]
                    if have:
                        flat += [*have, -1]
                out.append((max(n, 1), flat))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int16()))], ["y", "n", "flat"])

    return map_batches(rows, each, "y int, n int, flat array<smallint>").toArrow()


def document_sums(w: np.ndarray, n_docs: int, ids: np.ndarray, sentence: np.ndarray, owner: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits of the sentences with features, sum of -log(1 - p) over each document's sentences)."""
    z = w[-1] + np.bincount(sentence, w[ids], len(owner))
    return z, np.bincount(owner, np.logaddexp(0, z), n_docs) + bare * np.logaddexp(0, w[-1])


def objective(w: np.ndarray, y: np.ndarray, ids: np.ndarray, sentence: np.ndarray, owner: np.ndarray, bare: np.ndarray) -> tuple[float, np.ndarray]:
    """(mean loss of the noisy-or over the documents, with decay of the weights; its gradient). The last of w is the bias.

    ids and sentence list the features of the sentences that have some, owner their documents; bare counts each document's others."""
    z, s = document_sums(w, len(y), ids, sentence, owner, bare)
    loss = np.where(y > 0, -np.log(-np.expm1(-np.maximum(s, 1e-12))), s).mean() + DECAY / 2 * (w[:-1] ** 2).sum()
    down = np.where(y > 0, -1 / np.maximum(np.expm1(s), 1e-2), 1.0)
    g_z = down[owner] / (1 + np.exp(-z))
    g = np.empty_like(w)
    g[:-1] = np.bincount(ids, g_z[sentence], len(w) - 1) / len(y) + DECAY * w[:-1]
    g[-1] = (g_z.sum() + (down * bare).sum() / (1 + np.exp(-w[-1]))) / len(y)
    return float(loss), g


def train(y: np.ndarray, n: np.ndarray, flat: list[list[int]], n_features: int, steps: int = STEPS) -> tuple[np.ndarray, float, tuple[float, float]]:
    """Weights and bias of the sentence model, by Adam on the likelihood of the document labels, and the curve of the scores."""
    size = np.array([len(f) for f in flat])
    ids, doc = np.array([x for f in flat for x in f], np.int64), np.repeat(np.arange(len(y)), size)
    stop = ids < 0
    sentence = np.cumsum(stop) - stop
    owner = doc[stop]
    ids, sentence = ids[~stop], sentence[~stop]
    bare = n - np.bincount(owner, minlength=len(y))
    w = np.zeros(n_features + 1)
    w[-1] = np.log(max(y.mean(), 1e-3) / max(n.mean(), 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, g = objective(w, y, ids, sentence, owner, bare)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = document_sums(w, len(y), ids, sentence, owner, bare)[1]
    return w[:-1], float(w[-1]), curve(log_odds(s), y)


def curve(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope (positive) and intercept of a logistic curve through (x, y), by damped Newton steps."""
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        g, h = np.array([((p - y) * x).sum(), (p - y).sum()]), p * (1 - p) + 1e-6
        step = np.linalg.solve(np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-6 * np.eye(2), g)
        a, c = float(np.clip(a - np.clip(step[0], -1, 1), 0.05, 10)), float(c - np.clip(step[1], -2, 2))
    return a, c


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = TRAIN_ROWS, most_features: int = FEATURES) -> SentenceModel:
    rows = training_rows(docs, labels.where(~held_out(F.col(id_col), 0)), most_rows, TRAIN_BYTES, id_col, text_col, label_col, "toxicity-train")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        rate = float(np.clip(n_toxic / n, 1e-6, 1 - 1e-6)) if n else 0.5
        return SentenceModel({}, float(np.log(rate / (1 - rate))))
    names = select_features(rows, n, n_toxic, most_features)
    t = bags(rows, names)
    w, b, fitted = train(t.column("y").to_numpy(), t.column("n").to_numpy(), t.column("flat").to_pylist(), len(names))
    return SentenceModel(dict(zip(names, w.tolist())), b, fitted)


def score(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text", located_at: float = 0.1) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, and offending: the sentences (start, end in characters, score) of a predicted document, worst first."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.curve))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), 0).alias("held_out"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SentenceModel(*held.value)
        for b in batches:
            p, bad = [], []
            for t in b.column("text").to_pylist():
                s, parts = m.score(t)
                p.append(s)
                top = max(x[2] for x in parts)
                bad.append([{"start": x[0], "end": x[1], "score": x[2]} for x in sorted(parts, key=lambda x: -x[2]) if x[2] >= min(located_at, top)] if s >= 0.5 else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(bad, kind)], ["doc_id", "held_out", "score", "predicted", "offending"])

    return map_batches(source, each, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")
