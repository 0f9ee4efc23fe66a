"""Partitions of a protein by its nearest seeds: starts, steps, climbs, and the search over numbers of domains.

Spark makes contacts and spreads the proteins; a task holds the coordinates and contacts of one protein at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LLOYD_ROUNDS = 100  # as in the method; a partition that hasn't settled by then is scored as it is
DIRECTIONS, STUCK, SHRINK, LEAST_STEP = 6, 10, 0.7, 0.5  # fixed values of the climb


def spread_start(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k seeds: a random point, then each time a point by its squared distance to the nearest seed."""
    seeds = [points[rng.integers(len(points))]]
    nearest = ((points - seeds[0]) ** 2).sum(axis=1)
    while len(seeds) < k:
        total = nearest.sum()
        seeds.append(points[rng.choice(len(points), p=nearest / total) if total > 0 else rng.integers(len(points))])
        nearest = np.minimum(nearest, ((points - seeds[-1]) ** 2).sum(axis=1))
    return np.array(seeds, float)


def assign(points: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return np.argmin(((points[:, None, :] - seeds[None]) ** 2).sum(axis=2), axis=1)


def settle(points: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds moved to the middle of their points until no point changes; a seed without points goes to the farthest one."""
    before = None
    for _ in range(LLOYD_ROUNDS):
        label = assign(points, seeds)
        if before is not None and (label == before).all():
            break
        before = label
        for c in range(len(seeds)):
            own = label == c
            seeds[c] = points[own].mean(axis=0) if own.any() else points[np.argmax(((points[:, None, :] - seeds[None]) ** 2).sum(axis=2).min(axis=1))]
    return seeds, assign(points, seeds)


def crossings(label: np.ndarray) -> int:
    """How often neighbours along the chain are in different domains."""
    return int((label[1:] != label[:-1]).sum())


def modularity_of(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    if not len(a):
        return 0.0
    k = int(label.max()) + 1
    inside = np.bincount(label[a[label[a] == label[b]]], minlength=k)
    degree = np.bincount(label[a], minlength=k) + np.bincount(label[b], minlength=k)
    return float((inside / len(a) - (degree / (2 * len(a))) ** 2).sum())


Score = Callable[[np.ndarray, np.ndarray, np.ndarray], float]


def compact_score(crossing: float = 0.5, domain: float = 5.0) -> Score:
    """Modularity in thousandths less a price for each crossing and each domain."""
    return lambda label, a, b: 1000 * modularity_of(label, a, b) - crossing * crossings(label) - domain * len(np.unique(label))


def chain_score(bonus: float = 50, crossing: float = 50, min_size: int = 30, small: float = 50) -> Score:
    """A bonus for each domain of min_size, less a price for each crossing beyond those a chain of them needs and for each
    smaller domain."""

    def score(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
        sizes = np.bincount(label)
        large, few = int((sizes >= min_size).sum()), int(((sizes > 0) & (sizes < min_size)).sum())
        return bonus * large - crossing * max(0, crossings(label) - max(0, large - 1)) - small * few

    return score


def climb(points: np.ndarray, seeds: np.ndarray, value: Callable[[np.ndarray], float], rng: np.random.Generator, step: float = 5.0) -> np.ndarray:
    """Seeds moved one at a time in random directions while that raises the value; steps shrink when none does."""
    best, stuck = value(assign(points, seeds)), 0
    while step >= LEAST_STEP:
        better = False
        for c in range(len(seeds)):
            for _ in range(DIRECTIONS):
                way = rng.standard_normal(3)
                moved = seeds.copy()
                moved[c] += step * way / np.linalg.norm(way)
                new = value(assign(points, moved))
                if new > best:
                    best, seeds, better = new, moved, True
                    break
            if better:
                break
        stuck = 0 if better else stuck + 1
        if stuck >= STUCK:
            step, stuck = step * SHRINK, 0
    return seeds


def best_partition(residues: DataFrame, edges: DataFrame, domains: list[int], score: Score, restarts: int = 5, climbing: bool = False) -> DataFrame:
    """prot, idx, dom, k, score: of each protein the best scored partition over all numbers of domains and restarts
    (ties: the first). Each restart begins with spread seeds, settles, and climbs if asked to. Random numbers follow from
    the protein's name, so results repeat; domains are numbered from 1 by their first residue.
    """

    def search(key: tuple, rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        points, idx = rows[["x", "y", "z"]].to_numpy(float), rows.idx.to_numpy()
        if not len(points):
            return pd.DataFrame([], columns=["prot", "idx", "dom", "k", "score"])
        known = near[near.i.isin(idx) & near.j.isin(idx)]
        a, b = np.searchsorted(idx, known.i.to_numpy()), np.searchsorted(idx, known.j.to_numpy())
        rng = np.random.default_rng([ord(c) for c in str(key[0])])
        best: tuple[float, int, np.ndarray | None] = (-np.inf, 0, None)
        for k in domains:
            if k > len(points):
                continue
            for _ in range(restarts if k > 1 else 1):
                seeds, label = settle(points, spread_start(points, k, rng))
                if climbing and k > 1:
                    label = assign(points, climb(points, seeds, lambda x: score(x, a, b), rng))
                value = score(label, a, b)
                if value > best[0]:
                    best = (value, k, label)
        value, k, label = best
        if label is None:
            return pd.DataFrame([], columns=["prot", "idx", "dom", "k", "score"])
        first = {c: n for n, c in enumerate(dict.fromkeys(label), 1)}
        return pd.DataFrame({"prot": key[0], "idx": idx, "dom": [first[c] for c in label], "k": k, "score": value})

    kind = residues.schema["prot"].dataType.simpleString()
    points = residues.select("prot", "idx", "x", "y", "z").groupBy("prot")
    near = edges.select(*[F.col(c).alias(c) for c in ("prot", "i", "j")]).groupBy("prot")
    return points.cogroup(near).applyInPandas(search, f"prot {kind}, idx int, dom int, k int, score double")
