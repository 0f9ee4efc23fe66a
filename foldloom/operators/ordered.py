"""Global order without a single-task sort: range partitions over sampled quantiles, numbered by offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.scratch import cut

ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def number_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with bigint `name`: 0, 1, 2, ... in the order of keys over all rows.

    Rows are range-partitioned and sorted, so no task holds more than a share of the rows, also where one value of
    the first key holds most of them. Rows equal in all keys are numbered in any order. The driver sees one number
    for each partition. Nulls come first; an empty df gives an empty result.
    """
    local = f"{name}__local"
    parts = cut(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(local, F.monotonically_increasing_id()), name
    )
    part = F.shiftright(local, ROW_BITS)
    sizes = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["part"], total))
        total += row["n"]
    if not offsets:
        return parts.withColumn(name, F.col(local)).drop(local)
    table = df.sparkSession.createDataFrame(offsets, f"{name}__part bigint, {name}__first bigint").coalesce(1)
    return (
        parts.withColumn(f"{name}__part", part)
        .join(F.broadcast(table), f"{name}__part")  # one row for each partition
        .withColumn(name, F.col(f"{name}__first") + F.col(local).bitwiseAND((1 << ROW_BITS) - 1))
        .drop(local, f"{name}__part", f"{name}__first")
    )


def next_in_order(df: DataFrame, position: str, columns: list[str], chunk: int = 1 << 16) -> DataFrame:
    """df with next_<column>: the value in the row of the next higher position; null in the last row. Positions are
    different whole numbers from 0.

    The window runs over chunks of positions; the last row of a chunk is then stitched to the first one of the next, and
    these firsts, one for each chunk, are put in order in the same way: so no window holds more than `chunk` rows,
    but the last, which has one row for each chunk of chunks.
    """
    part = f"{position}__chunk"
    rows = df.withColumn(part, F.floor(F.col(position) / F.lit(chunk)).cast("bigint"))
    firsts = rows.groupBy(part).agg(F.min_by(F.struct(*columns), position).alias("first"))
    above = firsts.withColumn("above", F.floor(F.col(part) / F.lit(chunk)).cast("bigint"))
    tops = above.groupBy("above").agg(F.min_by("first", part).alias("top"))
    tops = tops.select("above", F.lead("top").over(Window.orderBy("above")).alias("beyond"))  # one row for 2^32 positions
    following = F.lead("first").over(Window.partitionBy("above").orderBy(part))
    firsts = above.withColumn("following", following).join(tops, "above").select(part, F.coalesce("following", "beyond").alias("following"))
    out = rows.withColumn("near", F.lead(F.struct(*columns)).over(Window.partitionBy(part).orderBy(position))).join(firsts, part, "left")
    picked = F.coalesce("near", "following")
    return out.select(*[df[c] for c in df.columns], *[picked[c].alias(f"next_{c}") for c in columns])


def fill_forward(df: DataFrame, position: str, column: str, chunk: int = 1 << 16) -> DataFrame:
    """df with the column's nulls replaced by its value at the nearest lower position that has one, if any; in the steps of
    next_in_order."""
    part, last = f"{position}__chunk", lambda w: F.last(column, ignorenulls=True).over(w)
    rows = df.withColumn(part, F.floor(F.col(position) / F.lit(chunk)).cast("bigint"))
    filled = last(Window.partitionBy(part).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    known = F.when(F.col(column).isNotNull(), F.col(position))
    carries = rows.groupBy(part).agg(F.max_by(column, known).alias(column), F.max(known).alias("at")).withColumn(column, F.when(F.col("at").isNotNull(), F.col(column)))
    above = carries.withColumn("above", F.floor(F.col(part) / F.lit(chunk)).cast("bigint"))
    tops = above.groupBy("above").agg(F.max_by(column, "at").alias(column))  # one row for 2^32 positions
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("above", last(before(Window.orderBy("above"))).alias("far"))
    above = above.select(part, "above", last(before(Window.partitionBy("above").orderBy(part))).alias("near")).join(tops, "above").select(part, F.coalesce("near", "far").alias("carried"))
    out = rows.withColumn(column, filled).join(above, part).withColumn(column, F.coalesce(column, "carried"))
    return out.select(*df.columns)
