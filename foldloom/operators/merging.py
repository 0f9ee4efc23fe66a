"""Domains merged by the errors between them, and ranges consolidated by their overlap.

Spark sums errors and distances by pairs of domains; only that table, of a protein's domains and not of its residues, is
worked off in a task, because each merge depends on the one before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def domain_pairs(errors: DataFrame, members: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """prot, a <= b, sum, n, distance: errors (prot, i, j, pae) between and inside domains (members prot, idx, dom), summed in
    both directions, and the least distance of two residues of different domains among near (prot, i, j, d), if any."""
    m = members.select("prot", "idx", "dom")
    both = lambda df: df.join(m.withColumnsRenamed({"idx": "i", "dom": "di"}), ["prot", "i"]).join(m.withColumnsRenamed({"idx": "j", "dom": "dj"}), ["prot", "j"])
    pair = [F.least("di", "dj").alias("a"), F.greatest("di", "dj").alias("b")]
    sums = both(errors).groupBy("prot", *pair).agg(F.sum("pae").alias("sum"), F.count("*").alias("n"))
    if near is None:
        return sums.withColumn("distance", F.lit(None).cast("double"))
    least = both(near).where("di <> dj").groupBy("prot", *pair).agg(F.min("d").alias("distance"))
    return sums.join(least, ["prot", "a", "b"], "left")


def adapted_threshold(median: Column, upper: Column, base: float) -> Column:
    """The threshold of merges for a protein with these quartiles of its errors: the upper one where errors are low, at
    most the base; else the base by the median."""
    # fixed values: what counts as low, the usual median, and how far the base may move
    scaled = F.greatest(F.lit(0.2 * base), F.least(F.lit(2.0 * base), base * median / 5))
    return F.when(median < 6, F.least(upper, F.lit(base))).otherwise(scaled)


class _Table:
    """Mean errors and least distances between the domains of one protein, kept up to date over merges."""

    def __init__(self, rows: pd.DataFrame, sizes: dict):
        self.names = sorted(sizes)
        at = {name: k for k, name in enumerate(self.names)}
        k = len(self.names)
        self.sum, self.n, self.distance = np.zeros((k, k)), np.zeros((k, k)), np.full((k, k), np.inf)
        for a, b, s, n, d in zip(rows.a, rows.b, rows["sum"], rows.n, rows.distance, strict=True):
            i, j = at[a], at[b]
            self.sum[i, j] = self.sum[j, i] = s
            self.n[i, j] = self.n[j, i] = n
            if d == d and d is not None:
                self.distance[i, j] = self.distance[j, i] = d
        self.size = np.array([sizes[name] for name in self.names], float)
        self.head = {name: name for name in self.names}

    def mean(self) -> np.ndarray:
        return np.divide(self.sum, self.n, out=np.full_like(self.sum, np.inf), where=self.n > 0)

    def merge(self, i: int, j: int) -> None:
        """j into i, i before j."""
        for x in (self.sum, self.n):
            inner = x[i, i] + x[j, j] + x[i, j]
            x[i] += x[j]
            x[:, i] = x[i]
            x[i, i] = inner
        self.distance[i] = np.minimum(self.distance[i], self.distance[j])
        self.distance[:, i] = self.distance[i]
        self.distance[i, i] = np.inf
        self.size[i] += self.size[j]
        self.head = {k: self.names[i] if v == self.names[j] else v for k, v in self.head.items()}
        del self.names[j]
        for name in ("sum", "n", "distance"):
            setattr(self, name, np.delete(np.delete(getattr(self, name), j, 0), j, 1))
        self.size = np.delete(self.size, j)


def _least(score: np.ndarray) -> tuple[int, int]:
    """The first pair i < j of least score."""
    i, j = np.triu_indices(len(score), 1)
    k = int(np.argmin(score[i, j]))
    return int(i[k]), int(j[k])


def _first(allowed: np.ndarray) -> tuple[int, int] | None:
    i, j = np.nonzero(np.triu(allowed, 1))
    return (int(i[0]), int(j[0])) if len(i) else None


def _simple(t: _Table, threshold: float, distance: float) -> tuple[int, int] | None:
    mean = t.mean()
    i, j = _least(mean)
    return (i, j) if mean[i, j] < threshold else None


def _size_weighted(t: _Table, threshold: float, distance: float) -> tuple[int, int] | None:
    mean = t.mean()
    i, j = _least(mean / (1 + np.minimum.outer(t.size, t.size) / 10))
    return (i, j) if mean[i, j] < threshold else None


def _boundary_strength(t: _Table, threshold: float, distance: float) -> tuple[int, int] | None:
    mean = t.mean()
    own = np.where(np.isfinite(np.diag(mean)), np.diag(mean), 0.0)
    return _first(mean - np.maximum.outer(own, own) < threshold)


def _spatial(t: _Table, threshold: float, distance: float) -> tuple[int, int] | None:
    return _first((t.mean() < threshold) & (t.distance < distance))


# the pair that a strategy merges next, if any; further strategies are added under their name
MERGES: dict[str, Callable[[_Table, float, float], tuple[int, int] | None]] = {
    "simple_merge": _simple,
    "size_weighted": _size_weighted,
    "boundary_strength": _boundary_strength,
    "spatial_merge": _spatial,
    "none": lambda t, threshold, distance: None,
}


def merged_domains(pairs: DataFrame, sizes: DataFrame, strategy: str, threshold: float, distance: float = 5.0) -> DataFrame:
    """prot, dom, head: each domain (sizes: prot, dom, n) with the first domain of the one it is merged into.

    pairs are those of domain_pairs. simple_merge takes the pair of least mean error while that is below the threshold;
    size_weighted the pair of least error by size; boundary_strength any pair whose error exceeds the errors inside by less
    than the threshold; spatial_merge any pair below the threshold that comes nearer than `distance`.
    """
    choose = MERGES[strategy]

    def work(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame([], columns=["prot", "dom", "head"])
        known = set(own.dom)
        t = _Table(rows[rows.a.isin(known) & rows.b.isin(known)], dict(zip(own.dom, own.n, strict=True)))
        while len(t.names) > 1 and (pair := choose(t, threshold, distance)):
            t.merge(*pair)
        return pd.DataFrame({"prot": key[0], "dom": list(t.head), "head": list(t.head.values())})

    kinds = dict(sizes.dtypes)
    right = sizes.select(*[F.col(c).alias(c) for c in ("prot", "dom", "n")]).groupBy("prot")
    return pairs.groupBy("prot").cogroup(right).applyInPandas(work, f"prot {kinds['prot']}, dom {kinds['dom']}, head {kinds['dom']}")


def _overlaps(s: np.ndarray, e: np.ndarray, i: int) -> np.ndarray:
    """Overlap of range i with all, by the smaller range."""
    common = np.minimum(e, e[i]) - np.maximum(s, s[i])
    small = np.minimum(e - s, e[i] - s[i])
    out = np.where((common > 0) & (small > 0), common / np.maximum(small, 1), 0.0)
    out[i] = -1
    return out


def consolidated(ranges: DataFrame, key: str, s: str, e: str, steps: tuple[float, ...] = (0.8, 0.5)) -> DataFrame:
    """key, seg_s, seg_e, n: ranges merged, always the two of greatest overlap (ties: the first pair in order of the ranges),
    while that is at least the first step, then the next one. A merged range reaches over both and takes the place of the
    first. Only the different ranges of a key meet in a task, and each merge looks at their best partners only.
    """

    def work(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([s, e])
        a, b, n = rows[s].to_numpy(float), rows[e].to_numpy(float), np.ones(len(rows), int)
        alive = np.ones(len(a), bool)
        best, with_ = np.full(len(a), -1.0), np.zeros(len(a), int)

        def look(i: int) -> None:
            """The best partner behind i."""
            part = np.where(alive, _overlaps(a, b, i), -1.0)
            part[: i + 1] = -1.0
            with_[i] = int(np.argmax(part)) if len(part) else 0
            best[i] = part[with_[i]]

        for i in range(len(a)):
            look(i)
        for step in steps:
            while (m := float(best[alive].max(initial=-1.0))) >= step and m > 0:
                i = int(np.flatnonzero(alive & (best == m))[0])
                j = with_[i]
                a[i], b[i], n[i], alive[j], best[j] = min(a[i], a[j]), max(b[i], b[j]), n[i] + n[j], False, -1.0
                changed = _overlaps(a, b, i)
                look(i)
                for k in np.flatnonzero(alive):
                    if k < i and (changed[k] > best[k] or (changed[k] == best[k] and i < with_[k])):
                        best[k], with_[k] = changed[k], i
                    elif k != i and with_[k] in (i, j):
                        look(k)
        return pd.DataFrame({key: key_[0], "seg_s": a[alive].astype(int), "seg_e": b[alive].astype(int), "n": n[alive]})

    kind = dict(ranges.dtypes)[key]
    rows = ranges.select(key, s, e).distinct().where(f"{s} is not null and {e} is not null")
    return rows.groupBy(key).applyInPandas(work, f"{key} {kind}, seg_s bigint, seg_e bigint, n bigint")
