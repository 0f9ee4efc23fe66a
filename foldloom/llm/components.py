"""Groups of records linked directly or through others (problem 2): Borůvka rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.scratch import cut


def _hooks(edges: DataFrame) -> DataFrame:
    """Parent of each vertex: the other end of its smallest edge; of two that chose one edge, the smaller is a root."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("u"), "a", "b")
    chosen = ends.groupBy("u").agg(F.min(F.struct("a", "b")).alias("edge"))
    pairs = chosen.groupBy("edge").agg(F.collect_list("u").alias("us"))  # an edge has two ends
    child = F.transform(
        "us",
        lambda u: F.struct(
            u.alias("u"),
            F.when(u == F.col("edge.b"), F.col("edge.a")).when(F.size("us") == 2, u).otherwise(F.col("edge.b")).alias("parent"),
        ),
    )
    return pairs.select(F.inline(child))


def _collapsed(parents: DataFrame) -> DataFrame:
    """Each vertex with its tree's root, by pointer doubling."""
    while True:
        up = parents.select(F.col("u").alias("parent"), F.col("parent").alias("grand"))
        doubled = parents.join(up, "parent").select("u", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
        doubled = cut(doubled, "parents")
        parents = doubled.select("u", "parent")
        if doubled.where("moved").isEmpty():
            return parents


def _relabelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges between different trees, once each."""
    a = edges.join(roots.select(F.col("u").alias("a"), F.col("parent").alias("ra")), "a")
    b = a.join(roots.select(F.col("u").alias("b"), F.col("parent").alias("rb")), "b")
    return b.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def group_linked(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """record, group_id: each value of either column with the smallest value of its group.

    Each round every component hooks to the other end of its smallest edge, so the components at least halve; the
    trees collapse by pointer doubling, edges are relabelled and deduplicated, until none is left. All steps are
    aggregates with partial sums, and joins with a table of one row for each vertex: a hub that holds a third of the
    rows makes one large partition on the side of the edges, which adaptive execution splits, as the other side's
    row can be repeated.

    A pair with a null end links nothing but names its other end; pairs of a value with itself, repeated and turned
    pairs change nothing; an empty table gives no rows; other columns are ignored.
    """
    named = cut(pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).distinct(), "pairs")
    records = named.select(F.explode(F.array("a", "b")).alias("record")).where("record is not null").distinct()
    edges = named.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        rounds.append(_collapsed(cut(_hooks(edges), "hooks")))
        edges = cut(_relabelled(edges, rounds[-1]), "edges")
    if not rounds:
        return records.select("record", F.col("record").alias("group_id"))
    roots = rounds.pop()
    while rounds:  # a root of an earlier round has its own root in the later ones, if its tree grew further
        later = roots.select(F.col("u").alias("parent"), F.col("parent").alias("top"))
        step = rounds.pop().join(later, "parent", "left")
        roots = cut(step.select("u", F.coalesce("top", "parent").alias("parent")), "roots")
    smallest = roots.groupBy("parent").agg(F.min("u").alias("group_id"))
    grouped = roots.join(smallest, "parent").select(F.col("u").alias("record"), "group_id")
    return records.join(grouped, "record", "left").select("record", F.coalesce("group_id", "record").alias("group_id"))
