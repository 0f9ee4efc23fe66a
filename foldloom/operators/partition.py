"""Splitting chains into domains: spectral cuts, optimal segmentation, and the view in which domains overlap least.

Spark makes the contacts and spreads the proteins; what one protein needs in its task grows with its contacts and residues,
never with their square: vectors come from products with the sparse contacts, the segmentation keeps one row of sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASIS, KEPT = 60, 15  # vectors of a search space, and of those that begin the next one
FAR_ENOUGH = 1e-10  # residual of a vector that has been found
SPACES = 500  # search spaces after which the search gives up


def _second_vector(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Second eigenvalue and vector of the normalised Laplacian of the edges a, b, w between n nodes of positive degree.

    The largest eigenvector of the scaled adjacency beside the trivial one, in growing spaces of its products.
    """
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    scale = 1 / np.sqrt(degree)
    weight = w * scale[a] * scale[b]
    trivial = np.sqrt(degree) / np.sqrt(degree.sum())
    times = lambda x: np.bincount(a, weight * x[b], n) + np.bincount(b, weight * x[a], n)
    if n < 2:
        return 0.0, trivial

    def fresh(x: np.ndarray, space: np.ndarray) -> np.ndarray | None:
        """x without its part in the space, or nothing if nothing is left."""
        size = np.linalg.norm(x)
        for _ in range(2):
            x = x - trivial * (trivial @ x)
            x = x - space.T @ (space @ x)
        left = np.linalg.norm(x)
        return x / left if left > 1e-12 * max(size, 1.0) else None

    space = np.empty((0, n))
    start = np.linspace(-1, 1, n) + 0.1 * np.random.default_rng(0).standard_normal(n)
    new, images = fresh(start, space), np.empty((0, n))
    for _ in range(SPACES):
        while new is not None and len(space) < BASIS:
            space, images = np.vstack([space, new]), np.vstack([images, times(new)])
            new = fresh(images[-1], space)
        values, y = np.linalg.eigh(space @ images.T)
        x, image = y[:, -1] @ space, y[:, -1] @ images
        rest = image - values[-1] * x
        if new is None or np.linalg.norm(rest) < FAR_ENOUGH:
            return 1 - float(values[-1]), x
        space, images = y[:, -KEPT:].T @ space, y[:, -KEPT:].T @ images
        new = fresh(rest, space)
    raise RuntimeError(f"no eigenvector after {SPACES} search spaces")


def _signed(v: np.ndarray) -> np.ndarray:
    clear = np.flatnonzero(np.abs(v) > 1e-9)
    return v * np.sign(v[clear[0]]) if len(clear) else v


def fiedler(edges: DataFrame) -> DataFrame:
    """prot, idx, value: the second eigenvector of the normalised Laplacian of the contacts, its first clearly
    non-zero entry positive. Residues without contacts have no row."""

    def vector(rows: pd.DataFrame) -> pd.DataFrame:
        idx, ends = np.unique(rows[["i", "j"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        _, v = _second_vector(len(idx), ends[:, 0], ends[:, 1], rows.w.to_numpy())
        return pd.DataFrame({"prot": rows.prot.iloc[0], "idx": idx, "value": _signed(v)})

    kind = edges.schema["prot"].dataType.simpleString()
    return edges.where("w > 0").groupBy("prot").applyInPandas(vector, f"prot {kind}, idx int, value double")


def bisected(edges: DataFrame, min_size: int = 30, depth: int = 5, max_conductance: float = 0.3, max_connectivity: float = 0.5) -> DataFrame:
    """prot, idx, dom: contacts cut in two by the sign of their second eigenvector, again and again.

    A part is cut unless it has less than 2 * min_size residues, was cut `depth` times, is too well connected (second
    eigenvalue), or the cut is poor: over max_conductance, or with a half under min_size. Domains are numbered from 1 by
    their first residue. Residues without contacts have no row.
    """

    def cut_up(rows: pd.DataFrame) -> pd.DataFrame:
        idx, ends = np.unique(rows[["i", "j"]].to_numpy(), return_inverse=True)
        ends, w = ends.reshape(-1, 2), rows.w.to_numpy()
        todo, parts = [(np.arange(len(idx)), 0)], []
        while todo:
            nodes, times = todo.pop()
            place = np.full(len(idx), -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[ends] >= 0).all(axis=1)
            a, b, v = place[ends[inside, 0]], place[ends[inside, 1]], w[inside]
            degree = np.bincount(a, v, len(nodes)) + np.bincount(b, v, len(nodes))
            linked = degree > 0
            halves = None
            if len(nodes) >= 2 * min_size and times < depth and linked.sum() > 1:
                compact = np.cumsum(linked) - 1
                value, vector = _second_vector(int(linked.sum()), compact[a], compact[b], v)
                side = np.zeros(len(nodes), bool)  # residues that lost all contacts stay with the first half
                side[linked] = _signed(vector) < 0
                least = min(degree[side].sum(), degree[~side].sum())
                poor = least <= 0 or v[side[a] != side[b]].sum() / least > max_conductance
                if value <= max_connectivity and not poor and min(side.sum(), (~side).sum()) >= min_size:
                    halves = [(nodes[~side], times + 1), (nodes[side], times + 1)]
            if halves:
                todo += halves
            else:
                parts.append(nodes)
        dom = np.empty(len(idx), int)
        for k, nodes in enumerate(sorted(parts, key=lambda x: x[0]), 1):
            dom[nodes] = k
        return pd.DataFrame({"prot": rows.prot.iloc[0], "idx": idx, "dom": dom})

    kind = edges.schema["prot"].dataType.simpleString()
    return edges.where("w > 0").groupBy("prot").applyInPandas(cut_up, f"prot {kind}, idx int, dom int")


def split_candidates(vectors: DataFrame) -> DataFrame:
    """prot, idx, why of positions where the vector changes sign or jumps by more than its mean step and two deviations."""
    by = Window.partitionBy("prot").orderBy("idx")
    step = F.abs(F.col("value") - F.lag("value").over(by))
    rows = vectors.withColumns({"step": step, "sign": F.lag("value").over(by) * F.col("value") < 0})
    limit = rows.groupBy("prot").agg((F.avg("step") + 2 * F.stddev_pop("step")).alias("limit"))
    rows = rows.join(limit, "prot").where("sign or step > limit")
    return rows.select("prot", "idx", F.when(F.col("sign"), "sign").otherwise("jump").alias("why"))


Worth = Callable[[np.ndarray, np.ndarray, float, int], np.ndarray]


def more_than_expected(inside: np.ndarray, size: np.ndarray, total: float, n: int) -> np.ndarray:
    """Contacts inside stretches less those expected of stretches of their sizes in a chain of n residues."""
    return inside - total * (size / n) ** 2


def _segmentation(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, penalties: np.ndarray, min_size: int, starts: np.ndarray, worth: Worth) -> list[tuple[float, list[tuple[int, int]]]]:
    """Of each penalty the worth and the segments of the best cut of 1..n into stretches that begin at one of starts."""
    order = np.argsort(j, kind="stable")
    i, j, w = i[order], j[order], w[order]
    to = np.searchsorted(j, np.arange(n + 2))
    total, by_start = float(w.sum()), np.zeros(n + 2)
    opt, own, parent = np.full((len(penalties), n + 1), -np.inf), np.zeros((len(penalties), n + 1)), np.zeros((len(penalties), n + 1), int)
    opt[:, 0] = 0
    ends = np.zeros(n + 1, bool)
    ends[[*(starts[starts > 1] - 1), n]] = True
    rows = np.arange(len(penalties))
    for end in range(1, n + 1):
        np.add.at(by_start, i[to[end] : to[end + 1]], w[to[end] : to[end + 1]])
        begins = starts[: np.searchsorted(starts, end - min_size + 1, "right")]
        if not ends[end] or not len(begins):
            continue
        inside = np.cumsum(by_start[::-1])[::-1][begins]  # contacts from the start on, up to end
        value = worth(inside, end - begins + 1, total, n)
        scores = opt[:, begins - 1] + value - penalties[:, None]
        k = np.argmax(scores, axis=1)
        opt[:, end], own[:, end], parent[:, end] = scores[rows, k], value[k], begins[k]
    found = []
    for r in rows:
        segments, end, sum_ = [], n, 0.0
        while end and np.isfinite(opt[r, n]):
            segments.append((int(parent[r, end]), end))
            sum_ += float(own[r, end])
            end = parent[r, end] - 1
        found.append((sum_, segments[::-1]))
    return found


def best_segments(edges: DataFrame, lengths: DataFrame, penalties: list[float], min_size: int, candidates: DataFrame | None = None, worth: Worth = more_than_expected) -> DataFrame:
    """prot, seg_s, seg_e, penalty: the segmentation of each chain (prot, n) of greatest value, over all penalties.

    A domain has the worth that the function gives for its contacts inside and its size; each costs the penalty. Of the
    penalties' optima the one with the greatest worth less domains times ln(n) is kept (ties: the smallest). With
    candidates (prot, idx) domains begin there only, or at the first residue; candidates less than min_size behind the
    one before are left out. Chains under min_size have no row.
    """

    restricted = candidates is not None

    def solve(key: tuple, rows: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=["prot", "seg_s", "seg_e", "penalty"])
        n, real = int(rows.n.iloc[0]), rows[rows.i.notna()]
        starts = np.arange(1, n + 1)
        if restricted:
            kept = [1]
            for c in sorted(set(cuts.idx)):
                if c - kept[-1] >= min_size:
                    kept.append(int(c))
            starts = np.array(kept)
        found = _segmentation(n, real.i.to_numpy(int), real.j.to_numpy(int), real.w.to_numpy(float), np.array(penalties), min_size, starts, worth)
        best: tuple[float, list] = (-np.inf, [])
        for penalty, (value, segments) in zip(penalties, found, strict=True):
            if segments and value - len(segments) * np.log(n) > best[0] + 1e-9:
                best = (value - len(segments) * np.log(n), [(key[0], a, b, penalty) for a, b in segments])
        return pd.DataFrame(best[1], columns=["prot", "seg_s", "seg_e", "penalty"])

    kind = lengths.schema["prot"].dataType.simpleString()
    rows = lengths.join(edges.select("prot", "i", "j", "w"), "prot", "left")
    schema = f"prot {kind}, seg_s int, seg_e int, penalty double"
    if not restricted:
        return rows.groupBy("prot").applyInPandas(lambda key, own: solve(key, own, pd.DataFrame({"idx": []})), schema)
    cuts = candidates.select(F.col("prot").alias("prot"), F.col("idx").alias("idx"))
    return rows.groupBy("prot").cogroup(cuts.groupBy("prot")).applyInPandas(solve, schema)


def best_rotation(residues: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """prot, k, overlap: of n directions spread evenly over the sphere the one from which the boxes around the domains
    overlap least (ties: the smallest k)."""
    golden = float(np.pi * (3 - np.sqrt(5)))
    rows = residues.join(members.select("prot", "idx", "dom"), ["prot", "idx"]).select("prot", "dom", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    theta, phi = F.col("k") * golden, F.acos(1 - 2 * (F.col("k") + 0.5) / n)
    ct, st, cp, sp = F.cos(theta), F.sin(theta), F.cos(phi), F.sin(phi)
    u = -st * F.col("x") + ct * F.col("y")
    w = ct * cp * F.col("x") + st * cp * F.col("y") - sp * F.col("z")
    boxes = rows.groupBy("prot", "k", "dom").agg(F.min(u).alias("u1"), F.max(u).alias("u2"), F.min(w).alias("w1"), F.max(w).alias("w2"))
    other = boxes.select("prot", "k", F.col("dom").alias("dom2"), *[F.col(c).alias(f"{c}b") for c in ("u1", "u2", "w1", "w2")])
    side = lambda c: F.greatest(F.lit(0.0), F.least(f"{c}2", f"{c}2b") - F.greatest(f"{c}1", f"{c}1b"))
    sums = boxes.join(other, ["prot", "k"]).withColumn("area", F.when(F.col("dom") < F.col("dom2"), side("u") * side("w")).otherwise(0.0))
    totals = sums.groupBy("prot", "k").agg(F.round(F.sum("area"), 6).alias("overlap"))
    return totals.groupBy("prot").agg(F.min(F.struct("overlap", "k")).alias("b")).select("prot", "b.k", "b.overlap")
