"""Greedy choices made for all groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.scratch import Pile, cut


def greedy_picks(nodes: DataFrame, conflicts: DataFrame, group: str, node: str, rank: str) -> DataFrame:
    """group, node, head: what a pass in order of (rank, node) over each group would decide.

    The pass picks a node unless a picked one before it is in conflict with it; then the first such takes it (its
    head). Picked nodes are their own head. conflicts holds group, a, b for each conflict, in either direction or both.

    Each round decides every node that no undecided node before it is in conflict with, in all groups; a chain of
    conflicts takes as many rounds as it is long.
    """
    ranks = nodes.select(group, node, F.struct(F.col(rank).alias("r"), F.col(node).alias("n")).alias("at"))
    both = conflicts.select(group, "a", "b").unionAll(conflicts.select(group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    first = ranks.select(group, F.col(node).alias("a"), F.col("at").alias("at_a"))
    second = ranks.select(group, F.col(node).alias("b"), F.col("at").alias("at_b"))
    before = cut(both.join(first, [group, "a"]).join(second, [group, "b"]).where("at_a < at_b"), "conflicts")
    left = cut(ranks, "left")
    pile = Pile(left.select(group, node), "picks")
    while not left.isEmpty():
        open_ = before.join(left.select(group, F.col(node).alias("b")), [group, "b"], "left_semi")
        waits = open_.join(left.select(group, F.col(node).alias("a")), [group, "a"], "left_semi").select(group, F.col("b").alias(node)).distinct()
        now = cut(left.join(waits, [group, node], "left_anti").select(group, node), "picked")
        taken = open_.join(now.select(group, F.col(node).alias("a")), [group, "a"], "left_semi").select(group, F.col("b").alias(node))
        left = cut(left.join(now.unionByName(taken), [group, node], "left_anti"), "left")
        pile.add(now)
    picked = pile.rows()
    heads = before.join(picked.select(group, F.col(node).alias("a")), [group, "a"], "left_semi").groupBy(group, "b").agg(F.min("at_a").alias("by"))
    rest = heads.join(picked.select(group, F.col(node).alias("b")), [group, "b"], "left_anti").select(group, F.col("b").alias(node), F.col("by.n").alias("head"))
    return picked.select(group, node, F.col(node).alias("head")).unionByName(rest)


def first_for_both_keys(pairs: DataFrame, pair: str, key_a: str, key_b: str, rank: str) -> DataFrame:
    """The rows that a pass in order of (rank, pair) keeps if each key may be used once, by key_a or key_b of any row.

    A row that comes first among those left for both of its keys is kept by the pass in any case, so all such rows are
    kept at once; rows that use a key of a kept one leave, and it goes on. Keys are of one type and never null.
    """
    left = cut(pairs.select(pair, key_a, key_b, F.struct(F.col(rank).alias("r"), F.col(pair).alias("p")).alias("at")), "left")
    pile = Pile(left.select(pair, key_a, key_b), "kept")
    while not left.isEmpty():
        keys = left.select("at", F.explode(F.array(key_a, key_b)).alias("key"))
        first = keys.groupBy("key").agg(F.min("at").alias("first"))
        a = first.select(F.col("key").alias(key_a), F.col("first").alias("first_a"))
        b = first.select(F.col("key").alias(key_b), F.col("first").alias("first_b"))
        now = cut(left.join(a, key_a).join(b, key_b).where("first_a = at and first_b = at").select(pair, key_a, key_b), "kept")
        used = now.select(F.explode(F.array(key_a, key_b)).alias("key")).distinct()
        rest = left.join(used.withColumnRenamed("key", key_a), key_a, "left_anti").join(used.withColumnRenamed("key", key_b), key_b, "left_anti")
        left = cut(rest.select(pair, key_a, key_b, "at"), "left")
        pile.add(now)
    return pile.rows()


def used_once(pairs: DataFrame, groups: list[str], a: str, b: str, columns: list[str]) -> DataFrame:
    """columns of the rows that a pass in order of (a, b) over each group keeps if each number may be used once in it, as a or b.

    a and b are whole numbers, never null. The window puts a group in one task, in order, and shuffles only what isn't
    partitioned by some of groups already; the pass holds the numbers used in one group.
    """
    at = Window.partitionBy(*groups).orderBy(a, b)
    rows = pairs.select(*columns, F.col(a).cast("bigint").alias("_a"), F.col(b).cast("bigint").alias("_b"), F.row_number().over(at).alias("_nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set[int] = set()  # in the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, nth = (batch.column(c).to_numpy() for c in ("_a", "_b", "_nth"))
            keep = nth == 1
            later = np.flatnonzero(~keep)
            for k, p, q, n in zip(later.tolist(), x[later].tolist(), y[later].tolist(), nth[later].tolist(), strict=True):
                if n == 2 and k:
                    used = {int(x[k - 1]), int(y[k - 1])}
                if p not in used and q not in used:
                    keep[k] = True
                    used |= {p, q}
            if keep[-1] and nth[-1] == 1:
                used = {int(x[-1]), int(y[-1])}
            yield batch.select(columns).filter(pa.array(keep))

    return rows.mapInArrow(run, pairs.select(*columns).schema)
