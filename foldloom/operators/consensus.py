"""Consensus domains of a family: clusters of similar boundaries and their scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions.intervals import shorter_fraction
from foldloom.operators.greedy import greedy_picks
from foldloom.operators.intervals import overlap_join
from foldloom.scratch import cut


def clusters_by_start(rows: DataFrame, keys: list[str], s: str, order: list[str], tolerance: int) -> DataFrame:
    """rows with `cluster` from 1: a new one begins where the start is more than tolerance beyond the one before."""
    by = Window.partitionBy(*keys).orderBy(s, *order)
    jump = F.when(F.col(s) - F.lag(s).over(by) <= tolerance, 0).otherwise(1)
    return rows.withColumn("_jump", jump).withColumn("cluster", F.sum("_jump").over(by)).drop("_jump")


def clusters_by_similarity(rows: DataFrame, key: str, s: str, e: str, tolerance: int = 10) -> DataFrame:
    """rows with `cluster` from 0: in order of (s, e) a domain joins the open cluster if either of its ends is less than
    tolerance from that of any member; otherwise it opens the next one.

    Only the different pairs of ends of a key meet in one task; they are as many as alignment columns squared at most,
    whatever number of rows has them.
    """

    def scan(ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values([s, e]).reset_index(drop=True)
        cluster, last_start, seen, out = -1, None, set(), []
        for a, b in zip(ends[s], ends[e], strict=True):
            near = last_start is not None and (a - last_start < tolerance or any(x in seen for x in range(b - tolerance + 1, b + tolerance)))
            if not near:
                cluster, seen = cluster + 1, set()
            seen.add(b)
            last_start = a
            out.append(cluster)
        return ends.assign(cluster=out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ends = rows.select(key, s, e).distinct().where(F.col(key).isNotNull() & F.col(s).isNotNull() & F.col(e).isNotNull())
    found = ends.groupBy(key).applyInPandas(scan, f"{key} {kinds[key]}, {s} {kinds[s]}, {e} {kinds[e]}, cluster int")
    return rows.join(found, [key, s, e])


def consensus(rows: DataFrame, keys: list[str], s: str, e: str, sequence: str, method: str) -> DataFrame:
    """Of each cluster: whole-number medians of starts and ends, rows, different sequences and methods."""
    middle = lambda c: F.floor(F.percentile(c, F.lit(0.5))).cast("bigint")
    return rows.groupBy(*keys, "cluster").agg(
        middle(s).alias("cons_s"),
        middle(e).alias("cons_e"),
        F.count("*").alias("n"),
        F.countDistinct(sequence).alias("n_sequences"),
        F.countDistinct(method).alias("n_methods"),
    )


# scores of a cluster by its aggregates; further strategies are added under their name
STRATEGIES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "majority": lambda coverage, methods, n, total: coverage,
    "method_agreement": lambda coverage, methods, n, total: methods / 3.0,
    "combined": lambda coverage, methods, n, total: 0.5 * (methods / 3.0) + 0.5 * coverage,
    "any_two_methods": lambda coverage, methods, n, total: F.when(methods < 2, F.lit(0.0)).otherwise(coverage),
    "all_three_methods": lambda coverage, methods, n, total: F.when(methods < 3, F.lit(0.0)).otherwise(coverage),
    "weighted_method": lambda coverage, methods, n, total: n / total / 3.0,
}


def scored(clusters: DataFrame, total: str) -> DataFrame:
    """clusters with a column for each strategy, over `total` sequences of the family."""
    n = F.col(total)
    coverage = F.col("n_sequences") / n
    return clusters.withColumns({name: F.round(f(coverage, F.col("n_methods"), F.col("n"), n), 6) for name, f in STRATEGIES.items()})


def without_overlaps(clusters: DataFrame, key: str, s: str, e: str, score: str, max_overlap: float = 0.5) -> DataFrame:
    """By falling score (ties: start, end), the domains that no better kept domain of the key overlaps by more than
    max_overlap of the shorter of the two."""
    rows = clusters.select(key, F.col(s).alias("s"), F.col(e).alias("e"), (-F.col(score)).alias("rank")).distinct()
    rows = cut(rows.withColumn("node", F.struct("rank", "s", "e")), "clusters")
    other = rows.select(key, F.col("node").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    near = overlap_join(rows.select(key, F.col("node").alias("a"), "s", "e"), other, key, "s", "e", "s2", "e2").where("a < b")
    near = near.where(shorter_fraction("s", "e", "s2", "e2") > max_overlap).select(key, "a", "b")
    kept = greedy_picks(rows.select(key, "node", F.col("node.rank").alias("rank")), near, key, "node", "rank").where("node = head")
    return kept.select(key, F.col("node.s").alias(s), F.col("node.e").alias(e), (-F.col("node.rank")).alias(score))


def method_consistency(rows: DataFrame, family: str, method: str, sequence: str, s: str, e: str) -> DataFrame:
    """How uniform a method is over a family: half the share of sequences in the largest cluster, a quarter the share
    with the commonest number of domains, a quarter how little the boundaries of the largest cluster vary.

    rows hold the cluster of each domain. Ties: the first cluster, the smallest number of domains.
    """
    keys = [family, method]
    totals = rows.groupBy(*keys).agg(F.countDistinct(sequence).alias("n_sequences"), F.count("*").alias("n_domains"))
    per_sequence = rows.groupBy(*keys, sequence).agg(F.count("*").alias("k")).groupBy(*keys, "k").agg(F.count("*").alias("times"))
    mode = per_sequence.groupBy(*keys).agg(F.max(F.struct("times", (-F.col("k")).alias("minus"))).alias("mode"))
    spread = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    sizes = rows.groupBy(*keys, "cluster").agg(F.count("*").alias("size"), F.countDistinct(sequence).alias("main"), spread(s).alias("sd_s"), spread(e).alias("sd_e"))
    largest = sizes.groupBy(*keys).agg(F.max(F.struct("size", (-F.col("cluster")).alias("minus"), "main", "sd_s", "sd_e")).alias("c"))
    tight = 1 - F.least((F.col("c.sd_s") + F.col("c.sd_e")) / 2, F.lit(50.0)) / 50
    score = 0.5 * F.col("c.main") / F.col("n_sequences") + 0.25 * F.col("mode.times") / F.col("n_sequences") + 0.25 * tight
    return (
        totals.join(mode, keys)
        .join(largest, keys)
        .select(*keys, "n_sequences", "n_domains", F.col("c.main").alias("in_main"), (-F.col("mode.minus")).alias("usual_count"), F.round(score, 6).alias("consistency"))
    )
