"""Embedding whitening by a randomised range finder.

Entries become whole numbers x = floor(1024 c) + 100000, whose sums S are exact, so a row is centred as (n x - S) / n
before it is multiplied with anything. A pass over all rows takes a block Q of columns to V Q, V the covariance: each task
sums its rows' products, and the tasks' sums meet by matrix row, so the driver gets one block of dimension x columns and
never a row of the table. The range finder starts from `COMPONENTS + OVERSAMPLE` random columns and makes `POWER` further
passes; Rayleigh-Ritz in the span gives eigenpairs, and V Q, which is at hand, their residuals. Where a residual is over
`RESIDUAL` of the largest eigenvalue the span is expanded to the full dimension, in blocks of `BLOCK` columns, where
Rayleigh-Ritz is exact to double precision. (A spectrum without a gap behind the wanted components needs that.)

The centred sums are zero, so the whitened values have the mean zero; their covariance is summed in one more pass.

Bounds: the driver holds matrices of dimension x dimension, dimensions up to `MOST_DIMENSIONS`; longer vectors raise.

Defined cases: rows go whose vector is null, or has a null or non-finite entry or one of 2^52 or more, whose x a long sum
of products could not hold. Vectors shorter than the longest are filled up with zeros, empty ones too. Only components whose
eigenvalue is above rounding are returned, so equal rows, one row or an empty table give none. A deviation above the range
of a long is null. Repeated rows count and come back as often as they occur; a null id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import map_batches

COMPONENTS = 8
OVERSAMPLE = 8
POWER = 2
#: Residuals allowed, as a share of the largest eigenvalue.
RESIDUAL = 1e-13
#: Columns of one pass.
BLOCK = 256
MOST_DIMENSIONS = 4096
SCALE, SHIFT = 1024, 100_000
MOST_ENTRY = 2.0**52


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is whole: not null, all entries finite and within the range of x."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < MOST_ENTRY)
    return vectors.where(F.col(vec_col).isNotNull() & F.forall(vec_col, ok))


def whole_numbers(column: pa.ListArray, d: int) -> np.ndarray:
    """x of a batch: rows x d, short vectors filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, c = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == d).all():
        full = c.reshape(len(sizes), d)
    else:
        full = np.zeros((len(sizes), d))
        full[np.arange(d) < sizes[:, None]] = c
    return np.floor(SCALE * full).astype(np.int64) + SHIFT


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs where they fit, as Python's numbers where not."""
    if len(x) and max(int(np.abs(x).max()) * n, max(map(abs, sums))) < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def summed(rows: DataFrame, vec_col: str, width: int, part: Callable[[pa.ListArray], np.ndarray], height: int) -> np.ndarray:
    """The sum over all batches of part(batch), a matrix of height x width, summed by task and then by matrix row."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = part(b.column(0))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height)), pa.array(list(total))], ["row", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            flat = b.column(1).flatten().to_numpy().reshape(b.num_rows, width)
            for row, sums in zip(b.column(0).to_pylist(), flat):
                totals[row] = totals[row] + sums if row in totals else sums
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["row", "sums"])

    schema = "row long, sums array<double>"
    out = np.zeros((height, width))
    for r in map_batches(map_batches(rows.select(vec_col), tasks, schema, "whitening").repartition("row"), merged, schema, "whitening").collect():
        out[r.row] = r.sums
    return out


def counts(rows: DataFrame, vec_col: str) -> tuple[int, list[int]]:
    """Number of rows and exact sums of x by dimension, in one pass; halves of x are summed apart so that no sum overflows."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for b in batches:
            if b.num_rows:
                x = whole_numbers(b.column(0), max(len(total), int(pc.max(pc.list_value_length(b.column(0))).as_py())))
                total += [SHIFT * n] * (x.shape[1] - len(total))
                n += len(x)
                total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int64()), pa.array(["0", *map(str, total)]), pa.array([n] * (len(total) + 1))], ["row", "value", "n"])

    parts = map_batches(rows.select(vec_col), tasks, "row long, value string, n long", "whitening")
    got = {r.row: (int(r.total), r.n) for r in parts.groupBy("row").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()}
    n = got.pop(-1, (0, 0))[1]
    return n, [got[k][0] + SHIFT * (n - got[k][1]) for k in range(len(got))]  # tasks of shorter vectors have zeros there


def covariance_times(rows: DataFrame, vec_col: str, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q, `BLOCK` columns a pass, and the trace of V."""
    d = len(sums)

    def one(block: np.ndarray) -> np.ndarray:
        def part(column: pa.ListArray) -> np.ndarray:
            c = offsets(whole_numbers(column, d), n, sums).astype(np.float64) / n
            return np.hstack([c.T @ (c @ block), (c * c).sum(0)[:, None]])

        return summed(rows, vec_col, block.shape[1] + 1, part, d) / n

    parts = [one(q[:, k : k + BLOCK]) for k in range(0, q.shape[1], BLOCK)]
    return np.hstack([m[:, :-1] for m in parts]), math.fsum(parts[0][:, -1])


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, vectors and residuals of V in the span of q, falling."""
    b = q.T @ vq
    e, w = np.linalg.eigh((b + b.T) / 2)
    e, w = e[::-1], w[:, ::-1]
    v = q @ w
    return e, v, np.linalg.norm(vq @ w - v * e, axis=0)


def fit(rows: DataFrame, vec_col: str, k: int = COMPONENTS, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = 7) -> dict:
    """n, sums, values, vectors (dimension x components), trace: what project() needs. rows come from usable()."""
    n, sums = counts(rows, vec_col)
    size = len(sums)
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {size} entries, {MOST_DIMENSIONS} at most")
    model = {"n": n, "sums": sums, "values": np.zeros(0), "vectors": np.zeros((size, 0)), "trace": 0.0, "expanded": False}
    if not size:
        return model
    width = min(size, k + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0] if width < size else np.eye(size)
    for step in range(power + 1):
        vq, trace = covariance_times(rows, vec_col, n, sums, q)
        e, v, off = ritz(q, vq)
        if width == size or off[:k].max() <= RESIDUAL * max(e[0], 0):
            break
        if step < power:
            q = np.linalg.qr(vq)[0]
    else:
        model["expanded"], q = True, np.eye(size)
        e, v, off = ritz(q, covariance_times(rows, vec_col, n, sums, q)[0])
    most = min(k, int((e > 16 * size * np.finfo(float).eps * max(e[0], 0)).sum())) if trace > 0 else 0
    return model | {"values": e[:most], "vectors": v[:, :most], "trace": trace}


def whiten(column: pa.ListArray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """n x - S and the whitened values of a batch."""
    off = offsets(whole_numbers(column, len(model["sums"])), model["n"], model["sums"])
    return off, (off.astype(np.float64) / model["n"]) @ model["vectors"] / np.sqrt(model["values"])


def identity_error(rows: DataFrame, vec_col: str, model: dict) -> float:
    """The largest entry of the whitened values' covariance minus the identity."""
    m = len(model["values"])

    def part(column: pa.ListArray) -> np.ndarray:
        w = whiten(column, model)[1]
        return w.T @ w

    return float(np.abs(summed(rows, vec_col, m, part, m) / model["n"] - np.eye(m)).max()) if m else 0.0


def squared(off: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null above the range of a long."""
    most = max(int(off.max()), -int(off.min())) if off.size else 0
    if off.dtype != object and most * most * off.shape[1] < 2**63:
        return (off * off).sum(1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in off]
    return [s if s < 2**63 else None for s in sums]


def project(rows: DataFrame, id_col: str, vec_col: str, model: dict, error: float) -> DataFrame:
    """One row for each row and component: id, component, n, deviation, whitened, explained, identity_error."""
    m = len(model["values"])
    explained = model["values"] / model["trace"] if m else np.zeros(0)
    kind = rows.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if m else ():
            if not b.num_rows:
                continue
            off, w = whiten(b.column(1), model)
            again, r = np.repeat(np.arange(b.num_rows), m), b.num_rows
            arrays = [b.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), r)), pa.array(np.full(r * m, model["n"])), pa.array(squared(off), pa.int64()).take(pa.array(again))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(w.ravel()), pa.array(np.tile(explained, r)), pa.array(np.full(r * m, error))], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(rows.select(id_col, vec_col), each, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double", "whitening")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Fit on all usable rows, then project them."""
    rows = usable(vectors.select(F.col(id_col).alias(id_col), F.col(vec_col).alias(vec_col)), vec_col)
    model = fit(rows, vec_col, k)
    return project(rows, id_col, vec_col, model, identity_error(rows, vec_col, model))
