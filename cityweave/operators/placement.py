"""Choosing places by a genetic search over coverage. (Greedy choices that keep their distance are in spacing.py.)"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def coverage_cost(cover: np.ndarray, genes: np.ndarray, area: np.ndarray, weight: np.ndarray, w_dark: float = 1.0, w_double: float = 0.2) -> float:
    """Weighted area that no chosen place covers, plus the area covered twice or more; cover is places x ground, boolean."""
    n = cover[genes].sum(0)
    return float(w_dark * (area * weight)[n == 0].sum() + w_double * area[n >= 2].sum())


def repair(genes: np.ndarray, places: int, rng: np.random.Generator) -> np.ndarray:
    """Distinct genes, the gaps filled from places that aren't used."""
    kept = np.array(list(dict.fromkeys(genes.tolist())), int)
    free = np.setdiff1d(np.arange(places), kept)
    return np.concatenate((kept, rng.choice(free, len(genes) - len(kept), replace=False))) if len(kept) < len(genes) else kept


def genetic(cover: np.ndarray, area: np.ndarray, weight: np.ndarray, k: int, seed: int = 0, size: int = 30, rounds: int = 40, elite: int = 2, mutation: float = 0.1, tournament: int = 3) -> tuple[np.ndarray, list[float]]:
    """(best set of k places, its cost after each round): elitism, tournaments, uniform crossover, mutation, repair."""
    rng = np.random.default_rng(seed)
    places = len(cover)
    crowd = [rng.choice(places, k, replace=False) for _ in range(size)]
    history = []
    for _ in range(rounds):
        cost = np.array([coverage_cost(cover, g, area, weight) for g in crowd])
        order = np.argsort(cost, kind="stable")
        history.append(float(cost[order[0]]))
        pick = lambda: crowd[min(rng.choice(size, tournament, replace=False), key=lambda j: cost[j])]  # noqa: E731, B023
        new = [crowd[j] for j in order[:elite]]
        while len(new) < size:
            a, b = pick(), pick()
            child = np.where(rng.random(k) < 0.5, a, b)
            child = np.where(rng.random(k) < mutation, rng.integers(0, places, k), child)
            new.append(np.sort(repair(child, places, rng)))
        crowd = new
    cost = [coverage_cost(cover, g, area, weight) for g in crowd]
    return crowd[int(np.argmin(cost))], history


def search_budgets(spark, cover: np.ndarray, area: np.ndarray, weight: np.ndarray, budgets: list[int], seeds: int = 2) -> DataFrame:
    """budget, seed, cost, places: searches for several numbers of places and seeds, in parallel over the broadcast coverage."""
    held = spark.sparkContext.broadcast((cover, area, weight))
    jobs = spark.createDataFrame([(b, s) for b in budgets for s in range(seeds)], "budget int, seed int").repartition(len(budgets) * seeds, "budget", "seed")

    def each(frames):
        c, a, w = held.value
        for pdf in frames:
            out = []
            for b, s in pdf.itertuples(index=False):
                best, _ = genetic(c, a, w, int(b), int(s))
                out.append((b, s, coverage_cost(c, best, a, w), best.tolist()))
            yield pd.DataFrame(out, columns=["budget", "seed", "cost", "places"])

    return jobs.mapInPandas(each, "budget int, seed int, cost double, places array<long>")
