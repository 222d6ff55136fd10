"""Shallow-water flood runs on regular grids: local-inertial flow, one run per task.

Runs (storms, designs, resolutions) are independent and are spread over the cluster; the cells of one run stay together,
since every time step couples them all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GRAVITY, DRY = 9.81, 1e-4
#: Depth from which a cell has a speed, and the least open share.
MOVING, TIGHTEST = 0.01, 0.05
COURANT, LONGEST_STEP = 0.7, 10.0


@dataclass
class Ground:
    """Layers of a grid; depth of water is over the open part of a cell."""

    dem: np.ndarray
    res: float
    manning: np.ndarray | float = 0.03
    infil_mmh: np.ndarray | float = 0.0
    rain_weight: np.ndarray | float = 1.0
    valid: np.ndarray | None = None
    drains: list[tuple[int, int, float]] = field(default_factory=list)
    #: Share of a cell that water can stand on; a face is as open as the tighter of its cells.
    open_share: np.ndarray | float = 1.0

    def full(self, layer) -> np.ndarray:
        return np.broadcast_to(np.asarray(layer, float), self.dem.shape).copy()


@dataclass
class Run:
    depth: np.ndarray
    max_depth: np.ndarray
    max_speed: np.ndarray
    max_hazard: np.ndarray
    frames: list[tuple[float, np.ndarray]]
    volumes: dict[str, float]
    steps: int


def rain_rate(steps: list[tuple[float, float, float]], t: float) -> float:
    """mm/h at time t."""
    return next((i for a, b, i in steps if a <= t < b), 0.0)


def face_flow(q: np.ndarray, surface: np.ndarray, bed: np.ndarray, rough: np.ndarray, dt: float, res: float, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """New unit discharge through the faces along an axis, and the depth of flow there."""
    lo = [slice(None)] * 2
    hi = [slice(None)] * 2
    lo[axis], hi[axis] = slice(None, -1), slice(1, None)
    lo, hi = tuple(lo), tuple(hi)
    deep = np.maximum(surface[lo], surface[hi]) - np.maximum(bed[lo], bed[hi])
    wet = deep > DRY
    h = np.where(wet, deep, 1.0)
    n = np.maximum(rough[lo], rough[hi])
    slope = (surface[hi] - surface[lo]) / res
    new = (q - GRAVITY * h * dt * slope) / (1.0 + GRAVITY * dt * n * n * np.abs(q) / h ** (7.0 / 3.0))
    return np.where(wet, new, 0.0), np.where(wet, h, 0.0)


def cell_speed(qx: np.ndarray, hx: np.ndarray, qy: np.ndarray, hy: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Length of the velocity in each cell: along each axis the mean of its two faces, of which dry ones count as still."""
    v = []
    for q, h, axis in ((qx, hx, 1), (qy, hy, 0)):
        face = np.divide(q, h, out=np.zeros_like(q), where=h > 0)
        pad = [(0, 0), (0, 0)]
        pad[axis] = (1, 1)
        face = np.pad(face, pad)
        lo, hi = [slice(None)] * 2, [slice(None)] * 2
        lo[axis], hi[axis] = slice(None, -1), slice(1, None)
        v.append((face[tuple(lo)] + face[tuple(hi)]) / 2)
    return np.where(depth > MOVING, np.hypot(*v), 0.0)


def simulate(g: Ground, steps: list[tuple[float, float, float]], duration: float, initial: np.ndarray | float = 0.0, save_every: float | None = None, closed: bool = False) -> Run:
    """Run a storm over a ground. Water leaves over the rim (unless closed) and into cells that aren't valid."""
    shape = g.dem.shape
    depth, rough, infil, weight = g.full(initial), g.full(g.manning), g.full(g.infil_mmh) / 3.6e6, g.full(g.rain_weight)
    keep = np.ones(shape, bool) if g.valid is None else g.valid.copy()
    sink = ~keep
    if not closed:
        sink[[0, -1], :] = True
        sink[:, [0, -1]] = True
    depth[~keep] = 0.0
    phi = np.maximum(g.full(g.open_share), TIGHTEST)
    wide_x, wide_y = np.minimum(phi[:, :-1], phi[:, 1:]), np.minimum(phi[:-1], phi[1:])
    qx, qy = np.zeros((shape[0], shape[1] - 1)), np.zeros((shape[0] - 1, shape[1]))
    area = g.res * g.res
    vol = dict.fromkeys(("rain", "infiltrated", "drained", "outflow"), 0.0)
    start = (depth * phi).sum() * area
    top_d, top_v, top_h = depth.copy(), np.zeros(shape), np.zeros(shape)
    breaks = sorted({x for a, b, _ in steps for x in (a, b)} | {duration} | (set(np.arange(save_every, duration, save_every)) if save_every else set()))
    frames, t, count = [], 0.0, 0
    while t < duration - 1e-9:
        limit = COURANT * g.res / np.sqrt(GRAVITY * max(depth.max(), 1e-3))
        dt = min(limit, LONGEST_STEP, next(b for b in breaks if b > t + 1e-9) - t)
        surface = g.dem + depth
        qx, hx = face_flow(qx, surface, g.dem, rough, dt, g.res, 1)
        qy, hy = face_flow(qy, surface, g.dem, rough, dt, g.res, 0)
        out = np.zeros(shape)  # no cell gives more than it holds
        out[:, :-1] += np.maximum(qx, 0) * wide_x
        out[:, 1:] -= np.minimum(qx, 0) * wide_x
        out[:-1] += np.maximum(qy, 0) * wide_y
        out[1:] -= np.minimum(qy, 0) * wide_y
        share = np.minimum(1.0, depth * phi * g.res / (out * dt + 1e-12))
        qx *= np.where(qx > 0, share[:, :-1], share[:, 1:])
        qy *= np.where(qy > 0, share[:-1], share[1:])
        fx, fy = qx * wide_x, qy * wide_y
        gain = np.zeros(shape)
        gain[:, :-1] -= fx
        gain[:, 1:] += fx
        gain[:-1] -= fy
        gain[1:] += fy
        depth = np.maximum(depth + gain * dt / (g.res * phi), 0.0)
        fall = rain_rate(steps, t) / 3.6e6 * dt * weight
        depth += fall / phi
        vol["rain"] += fall.sum() * area
        soak = np.minimum(infil * dt, depth)
        depth -= soak
        vol["infiltrated"] += (soak * phi).sum() * area
        for r, c, cap in g.drains:
            take = min(cap * dt / (area * phi[r, c]), depth[r, c])
            depth[r, c] -= take
            vol["drained"] += take * phi[r, c] * area
        vol["outflow"] += (depth * phi)[sink].sum() * area
        depth[sink] = 0.0
        t, count = t + dt, count + 1
        speed = cell_speed(qx, hx, qy, hy, depth)
        top_d, top_v, top_h = np.maximum(top_d, depth), np.maximum(top_v, speed), np.maximum(top_h, np.where(depth > MOVING, depth * (speed + 0.5), 0.0))
        if save_every and (abs(t / save_every - round(t / save_every)) < 1e-9 or t >= duration - 1e-9):
            frames.append((t, depth.copy()))
    vol["stored"] = (depth * phi).sum() * area
    lost = start + vol["rain"] - vol["infiltrated"] - vol["drained"] - vol["outflow"] - vol["stored"]
    vol["closure_rel"] = lost / max(vol["rain"] + start, 1e-9)
    return Run(depth, top_d, top_v, top_h, frames, vol, count)


RESULT = "run_id string, row int, col int, depth double, max_depth double, max_speed double, max_hazard double, rain_m3 double, outflow_m3 double, closure_rel double"


def run_all(cells: DataFrame, storms: dict[str, list[tuple[float, float, float]]], duration: float, res: float, run_col: str = "run_id") -> DataFrame:
    """Runs of all grids (run_id, row, col, dem, manning, infil_mmh, storm), in parallel over run_id; a run is one task's grid."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        at = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        layer = lambda k, fill: _place(pdf[k].to_numpy(float), at, (rows, cols), fill)
        valid = np.zeros((rows, cols), bool)
        valid[at] = True
        high = float(pdf["dem"].max())
        r = simulate(Ground(layer("dem", high), res, layer("manning", 0.03), layer("infil_mmh", 0.0), valid.astype(float), valid), storms[pdf["storm"].iloc[0]], duration)
        out = pdf[[run_col, "row", "col"]].copy()
        for k, a in (("depth", r.depth), ("max_depth", r.max_depth), ("max_speed", r.max_speed), ("max_hazard", r.max_hazard)):
            out[k] = a[at]
        return out.assign(rain_m3=r.volumes["rain"], outflow_m3=r.volumes["outflow"], closure_rel=r.volumes["closure_rel"])

    return cells.groupBy(run_col).applyInPandas(one, RESULT.replace("run_id", run_col, 1))


def _place(values: np.ndarray, at: tuple, shape: tuple[int, int], fill: float) -> np.ndarray:
    out = np.full(shape, fill)
    out[at] = values
    return out
