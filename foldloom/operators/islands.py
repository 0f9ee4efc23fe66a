"""Runs and islands along an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.scratch import cut


def runs(df: DataFrame, keys: list[str], index: str, gap: int) -> DataFrame:
    """keys, seg_s, seg_e, n: stretches of the index in which neighbours are at most gap apart."""
    by = Window.partitionBy(*keys).orderBy(index)
    new = F.when(F.col(index) - F.lag(index).over(by) <= gap, 0).otherwise(1)
    rows = df.select(*keys, index).withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    return rows.groupBy(*keys, "_run").agg(F.min(index).alias("seg_s"), F.max(index).alias("seg_e"), F.count("*").alias("n")).drop("_run")


def merged(df: DataFrame, keys: list[str], s: str, e: str, gap: int) -> DataFrame:
    """keys, seg_s, seg_e, n: intervals joined where no more than gap positions lie between them and all before."""
    by = Window.partitionBy(*keys).orderBy(s, e)
    reach = F.max(e).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.select(*keys, s, e).withColumn("_new", F.when(F.col(s) - reach <= gap, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(by))
    return rows.groupBy(*keys, "_run").agg(F.min(s).alias("seg_s"), F.max(e).alias("seg_e"), F.count("*").alias("n")).drop("_run")


def core_segments(segs: DataFrame, keys: list[str], far: int = 30, least: int = 5) -> DataFrame:
    """segs (keys, seg_s, seg_e) without those far from the core of their group.

    The core begins with the longest segment (ties: the later start) and takes in, round by round, segments at most
    `far` from it (5 for those under 10 residues). In the end segments of at least `least` within 50 stay too.
    """
    size = F.col("seg_e") - F.col("seg_s") + 1
    rows = cut(segs.select(*keys, "seg_s", "seg_e").distinct().withColumn("size", size), "segments")
    longest = rows.groupBy(*keys).agg(F.max(F.struct("size", "seg_s", "seg_e")).alias("x"))
    core = cut(longest.select(*keys, "x.seg_s", "x.seg_e"), "core")
    ends = [*keys, "seg_s", "seg_e"]

    def distances() -> DataFrame:
        rest = rows.join(core, ends, "left_anti")
        other = core.select(*keys, F.col("seg_s").alias("cs"), F.col("seg_e").alias("ce"))
        gap = F.greatest(F.lit(0), F.col("cs") - F.col("seg_e"), F.col("seg_s") - F.col("ce"))
        return rest.join(other, keys).groupBy(*ends, "size").agg(F.min(gap).alias("gap"))

    while True:
        near = cut(distances().where(F.col("gap") <= F.when(F.col("size") < 10, 5).otherwise(far)).select(*ends), "near")
        if near.isEmpty():
            return core.unionByName(distances().where(F.col("size") >= least).where("gap <= 50").select(*ends))
        core = cut(core.unionByName(near), "core")


def without_intrusions(labels: DataFrame, keys: list[str], index: str, label: str, least: int) -> DataFrame:
    """labels with runs of one label shorter than `least` taken over by the label that stands on both sides of them."""
    by = Window.partitionBy(*keys).orderBy(index)
    change = F.when(F.col(label) == F.lag(label).over(by), 0).otherwise(1)
    rows = labels.withColumn("_change", change).withColumn("_run", F.sum("_change").over(by))
    found = rows.groupBy(*keys, "_run").agg(F.first(label).alias("_own"), F.count("*").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_run")
    found = found.withColumns({"_before": F.lag("_own").over(along), "_after": F.lead("_own").over(along)})
    taken = F.when((F.col("_n") < least) & (F.col("_before") == F.col("_after")), F.col("_before")).otherwise(F.col("_own"))
    return rows.join(found.select(*keys, "_run", taken.alias("_new")), [*keys, "_run"]).withColumn(label, F.col("_new")).drop("_change", "_run", "_new")


def spaced(df: DataFrame, keys: list[str], index: str, least: int) -> DataFrame:
    """keys and index: along each group the first row, then each one at least `least` behind the last one taken."""
    ordered = F.sort_array(F.collect_set(index))
    empty = F.array().cast(f"array<{dict(df.dtypes)[index]}>")
    taken = F.aggregate("_all", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= least), F.array_append(acc, x)).otherwise(acc))
    return df.groupBy(*keys).agg(ordered.alias("_all")).select(*keys, F.explode(taken).alias(index))
