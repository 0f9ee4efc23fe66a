"""Continuous periods and gaps of overlapping intervals (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators.ordered import next_in_order, number_rows
from foldloom.scratch import cut


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Covered periods and free gaps of whole-number inclusive intervals, for each entity.

    Starts and ends are ranked independently over (entity, value). An entity has as many starts as ends, so it takes
    the same ranks in both orders: where the start of rank r + 1 lies more than one past the end of rank r, or belongs
    to another entity, a period ends and another begins. Both rankings are range-partitioned, so an entity may hold
    any share of the rows.

    Returns id (the entity), stretch ('period' or 'gap'), seq_start, seq_end. Intervals that touch without a free
    number between them form one period. Rows with a null, or with start > end, don't count; repeated rows change
    nothing; an empty table gives no rows; other columns are ignored.
    """
    base = df.select(F.col(entity).alias("id"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    base = base.where("id is not null and s is not null and e is not null and s <= e")
    # of equal starts only the longest interval matters, of equal ends too: no value of an entity stays heavy
    base = base.groupBy("id", "s").agg(F.max("e").alias("e")).groupBy("id", "e").agg(F.min("s").alias("s"))
    base = cut(base.select("id", "s", "e"), "periods")
    starts = number_rows(base.select("id", "s"), ["id", "s"], "rank")
    ends = number_rows(base.select("id", "e"), ["id", "e"], "rank").withColumn("rank", F.col("rank") + 1)
    ends = ends.select("rank", F.col("id").alias("end_id"), "e")
    breaks = starts.join(ends, "rank", "full").where("id is null or end_id is null or id <> end_id or s > e + 1")
    paired = next_in_order(breaks, "rank", ["e"])
    stretch = F.array(
        F.when(
            F.col("id").isNotNull(),
            F.struct(F.lit("period").alias("stretch"), F.col("s").alias("seq_start"), F.col("next_e").alias("seq_end")),
        ),
        F.when(
            F.col("id") == F.col("end_id"),
            F.struct(F.lit("gap").alias("stretch"), (F.col("e") + 1).alias("seq_start"), (F.col("s") - 1).alias("seq_end")),
        ),
    )
    out = paired.select("id", F.explode(F.array_compact(stretch)).alias("x"))
    return out.select("id", "x.stretch", "x.seq_start", "x.seq_end")
