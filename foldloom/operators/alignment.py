"""Columns of alignments: occupancy, trimming, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAPS = "[.-]"


def residue_columns(aln: str) -> Column:
    """Columns (from 1) of the residues of an aligned sequence, in order."""
    marked = F.transform(F.split(aln, ""), lambda c, i: F.when(~c.isin(".", "-", ""), i + 1))
    return F.filter(marked, lambda x: x.isNotNull())


def occupancy(rows: DataFrame, family: str, aln: str) -> DataFrame:
    """family, col (from 0), occ: the share of the family's rows with a residue in the column.

    Rows shorter than others have gaps behind their end. Counted per (family, column) before the shuffle, so a family
    of any size costs one task no more than its columns.
    """
    sizes = rows.groupBy(family).agg(F.count("*").alias("n"), F.max(F.length(aln)).alias("width"))
    filled = rows.select(family, F.explode(residue_columns(aln)).alias("col")).groupBy(family, "col").agg(F.count("*").alias("filled"))
    grid = sizes.select(family, "n", F.explode(F.sequence(F.lit(1), F.col("width"))).alias("col"))
    found = grid.join(filled, [family, "col"], "left")
    return found.select(family, (F.col("col") - 1).cast("bigint").alias("col"), (F.coalesce("filled", F.lit(0)) / F.col("n")).alias("occ"))


def smoothed(occ: DataFrame, family: str, window: int) -> DataFrame:
    """occ with `smooth`: the mean over `window` columns around each, fewer at the ends."""
    half = window // 2
    around = Window.partitionBy(family).orderBy("col").rowsBetween(-half, half)
    return occ.withColumn("smooth", F.avg("occ").over(around))


def trim_by_threshold(occ: DataFrame, family: str, threshold: float) -> DataFrame:
    """family, trim_start, trim_end: first and last column with at least the threshold, or the whole alignment."""
    good = F.when(F.col("occ") >= threshold, F.col("col"))
    rows = occ.groupBy(family).agg(F.coalesce(F.min(good), F.lit(0).cast("bigint")).alias("trim_start"), F.coalesce(F.max(good), F.max("col")).alias("trim_end"))
    return rows


def trim_by_gradient(occ: DataFrame, family: str, min_occupancy: float = 0.1, stop: float = 0.9) -> DataFrame:
    """family, trim_start, trim_end: where occupancy rises steepest, looking from either end up to the first column of
    occupancy `stop`; the first of equal rises counts."""
    by = Window.partitionBy(family)
    along = by.orderBy("col")
    rows = occ.withColumns(
        {
            "up": F.lead("occ").over(along) - F.col("occ"),
            "next_occ": F.lead("occ").over(along),
            "first_full": F.min(F.when(F.col("occ") >= stop, F.col("col"))).over(by),
            "last_full": F.max(F.when(F.col("occ") >= stop, F.col("col"))).over(by),
            "last": F.max("col").over(by),
        }
    ).where("up is not null or last = 0")
    up, col = F.round("up", 9), F.col("col")
    from_start = (col < F.greatest(F.coalesce("first_full", F.lit(0)), F.lit(1))) & (F.col("next_occ") >= min_occupancy)
    from_end = (col >= F.least(F.coalesce("last_full", "last"), F.col("last") - 1)) & (F.col("occ") >= min_occupancy)
    best = rows.groupBy(family).agg(
        F.max(F.when(from_start, F.struct(up.alias("g"), (-col).alias("p"), (col + 1).alias("at")))).alias("a"),
        F.max(F.when(from_end, F.struct((-up).alias("g"), (-col).alias("p"), col.alias("at")))).alias("b"),
        F.max("last").alias("last"),
    )
    return best.select(family, F.coalesce("a.at", F.lit(0).cast("bigint")).alias("trim_start"), F.coalesce("b.at", "last").alias("trim_end"))


def sliced(rows: DataFrame, aln: str, first: str, start: Column, end: Column) -> DataFrame:
    """rows with the columns start..end (from 0) of the alignment, and the residues that are left: new_first, new_last.
    A row without residues there gets (first, first - 1)."""
    letters = lambda c: F.length(F.regexp_replace(c, GAPS, ""))
    part = F.substr(aln, (start + 1).cast("int"), (end - start + 1).cast("int"))
    before = letters(F.substr(aln, F.lit(1), start.cast("int")))
    kept = letters(part)
    new_first = F.col(first) + F.when(kept > 0, before).otherwise(0)
    return rows.withColumns({"part": part, "new_first": new_first, "new_last": new_first + kept - 1})


def span_to_columns(rows: DataFrame, aln: str, first: str, last: str, s: str, e: str) -> DataFrame:
    """rows with col_s, col_e (from 1): the columns of residues s..e, clipped to the row's residues first..last; rows
    that share none are left out."""
    cols = residue_columns(aln)
    inside = rows.where(F.col(e) >= F.col(first)).where(F.col(s) <= F.col(last)).withColumn("_cols", cols)
    at = lambda residue: F.get("_cols", (residue - F.col(first)).cast("int"))
    out = inside.withColumns({"col_s": at(F.greatest(s, first)), "col_e": at(F.least(e, last))})
    return out.where("col_s is not null and col_e is not null").drop("_cols")
