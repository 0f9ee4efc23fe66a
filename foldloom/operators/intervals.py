"""Joins of intervals on the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 128  # residues of a bin: about the length of a domain


def overlap_join(left: DataFrame, right: DataFrame, key: str, ls: str, le: str, rs: str, re: str, width: int = BIN) -> DataFrame:
    """All pairs of rows with equal key whose intervals [ls, le] and [rs, re] share a position, each pair once.

    Both sides are repeated for each bin they touch and met on (key, bin), so the rows of one key spread over tasks
    and far intervals are never compared; a pair is kept in the bin where the later of the two starts. Rows with a
    null key or end, or an end before the start, meet nothing. Columns of right but key follow those of left; the
    other names must differ.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a = left.where(f"{ls} <= {le} and {key} is not null").withColumn("_bin", bins(ls, le))
    b = right.where(f"{rs} <= {re}").withColumnRenamed(key, "_key").withColumn("_right_bin", bins(rs, re))
    met = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_right_bin")) & (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le))
    once = F.col("_bin") == F.floor(F.greatest(ls, rs) / width)
    return a.join(b, met & once).drop("_key", "_bin", "_right_bin")


def _bits(s: str, e: str, bin_: str) -> str:
    """SQL of the positions of [s, e] in a bin of 64, as the bits of a number."""
    low, high = f"greatest({s} - {bin_} * 64, 0)", f"least({e} - {bin_} * 64, 63)"
    return f"shiftleft(shiftrightunsigned(-1L, cast(63 - ({high} - {low}) as int)), cast({low} as int))"


def without_overlap(left: DataFrame, right: DataFrame, key: str, row: list[str], ls: str, le: str, rs: str, re: str) -> DataFrame:
    """Rows of left, named by key and the columns row, none of whose intervals touches an interval of right on the same key.

    left may hold several intervals of one row; the result has one row for each, with key and row only. What right
    covers of a key becomes one number for each 64 positions, joined before the shuffle, so no pair is ever listed; a row
    of left looks up the stretches that it touches. Intervals with a null or with an end before the start touch nothing.
    """
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / 64), F.floor(F.col(e) / 64))
    covered = right.where(f"{rs} <= {re} and {key} is not null").select(key, rs, re, F.explode(bins(rs, re)).alias("_bin"))
    covered = covered.groupBy(key, "_bin").agg(F.bit_or(F.expr(_bits(rs, re, "_bin"))).alias("_covered"))
    own = left.select(key, *row, ls, le, F.explode_outer(F.when(F.col(ls) <= F.col(le), bins(ls, le))).alias("_bin"))
    met = own.join(covered, [key, "_bin"], "left")
    touches = F.coalesce(F.expr(f"_covered & {_bits(ls, le, '_bin')} <> 0"), F.lit(False))
    return met.groupBy(key, *row).agg(F.bool_or(touches).alias("_touches")).where("not _touches").drop("_touches")
