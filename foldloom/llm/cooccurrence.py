"""How often two items stand in one basket, against chance (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators.ordered import number_rows
from foldloom.scratch import cut

BLOCK = 512  # items of a basket that one task pairs with as many others
CODE_BITS = 31


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of a sorted partition of (code, n); a run may go on over batches."""
    code, total = None, 0
    for batch in batches:
        codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(codes):
            continue
        at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        sums, firsts = np.add.reduceat(n, at), codes[at]
        if code is not None:
            if firsts[0] == code:
                sums[0] += total
            else:
                firsts, sums = np.r_[code, firsts], np.r_[total, sums]
        code, total = firsts[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(firsts[:-1]), pa.array(sums[:-1])], names=["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], names=["code", "n"])


def _codes(own: F.Column, other: F.Column | None = None) -> F.Column:
    """Packed codes of the pairs within a sorted array of item codes, or between two arrays."""
    pack = lambda x, y: F.shiftleft(F.least(x, y), CODE_BITS).bitwiseOR(F.greatest(x, y))
    if other is None:
        pairs = F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: pack(x, y)))
    else:
        pairs = F.transform(own, lambda x: F.transform(other, lambda y: pack(x, y)))
    return F.flatten(pairs)


def count_pairs(
    df: DataFrame, basket: str, item: str, min_count: int = 1, min_ratio: float = 0.0, block: int = BLOCK
) -> DataFrame:
    """Of each pair of items a < b with at least min_count common baskets and at least min_ratio: n_ab, n_a, n_b, n
    (numbers of distinct baskets), ratio (n_ab * n / (n_a * n_b), observed to expected) and odds_ratio (with 0.5 added
    to each cell of the table of baskets with and without a and b).

    Items become codes in their own order, a pair one 64-bit code. Each task sorts its codes (spilling sorted runs,
    merging them) and counts run lengths; the counted codes are shuffled, sorted and counted again. Baskets of more
    than `block` items are cut in blocks of about that many, and tasks pair blocks, so no task holds a whole basket.
    Items that cannot reach the thresholds, whatever they occur with, are left out before pairing: n_ab <= n_a, and
    ratio <= n / n_a. So with a min_ratio items in most baskets make no pairs; results are the same.

    A pair's code holds 31 bits for each of its items; more than 2^31 items that can reach the thresholds raise an error.
    The joins have one row for each item or basket on one side, so adaptive execution splits what a frequent item or a
    large basket makes large on the other.

    Rows with null basket or item don't count, nor do repeats in a basket; an empty table gives no rows; other
    columns are ignored.
    """
    base = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    base = cut(base, "baskets")
    n = base.select("basket").distinct().count()
    counts = base.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= min_count)
    counts = counts.where(F.col("n_item") * F.lit(min_ratio) <= F.lit(n))
    items = cut(number_rows(counts, ["item"], "code"), "items")
    last = items.agg(F.max("code").alias("last")).first()["last"]
    if last is not None and last >> CODE_BITS:
        raise ValueError(f"{last + 1} items don't fit codes of {CODE_BITS} bits")
    rows = base.join(items.select("item", "code"), "item").select("basket", "code")
    sizes = rows.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = sizes.select(F.col("basket").alias("large"), F.ceil(F.col("size") / block).alias("blocks"))
    large = cut(large, "large")
    whole, split = rows, None
    if not large.isEmpty():
        placed = rows.join(large.withColumnRenamed("large", "basket"), "basket", "left")
        whole = placed.where("blocks is null").select("basket", "code")
        split = placed.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("code"), "blocks"))
    lists = whole.groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("own")).where(F.size("own") > 1)
    codes = lists.select(F.explode(_codes(F.col("own"))).alias("code"))
    if split is not None:
        own = F.sort_array(F.collect_list("code")).alias("own")
        parts = cut(split.groupBy("basket", "blocks", "block").agg(own), "blocks")
        # each pair of blocks has its own key, so one basket's pairs of blocks spread over tasks
        left = parts.where("block < blocks - 1").select("basket", F.col("block").alias("i"), F.explode(F.expr("sequence(block + 1, blocks - 1)")).alias("j"), "own")
        right = parts.where("block > 0").select("basket", F.explode(F.expr("sequence(0, block - 1)")).alias("i"), F.col("block").alias("j"), F.col("own").alias("other"))
        codes = codes.unionAll(parts.select(F.explode(_codes(F.col("own"))).alias("code")))
        codes = codes.unionAll(left.join(right, ["basket", "i", "j"]).select(F.explode(_codes(F.col("own"), F.col("other"))).alias("code")))
    counted = codes.select("code", F.lit(1).cast("bigint").alias("n"))
    for again in (False, True):
        counted = (counted.repartition("code") if again else counted).sortWithinPartitions("code").mapInArrow(_runs, "code bigint, n bigint")
    pairs = counted.where(F.col("n") >= min_count).select(
        F.shiftright("code", CODE_BITS).alias("code_a"), F.col("code").bitwiseAND((1 << CODE_BITS) - 1).alias("code_b"), F.col("n").alias("n_ab")
    )
    for side in "ab":
        of = items.select(F.col("code").alias(f"c_{side}"), F.col("item").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}"))
        pairs = pairs.join(of, F.col(f"code_{side}") == F.col(f"c_{side}"))
    d = lambda c: F.col(c).cast("double")
    ratio = d("n_ab") * F.lit(n) / (d("n_a") * d("n_b"))
    odds = ((d("n_ab") + 0.5) * (F.lit(n) - d("n_a") - d("n_b") + d("n_ab") + 0.5)) / ((d("n_a") - d("n_ab") + 0.5) * (d("n_b") - d("n_ab") + 0.5))
    out = pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), ratio.alias("ratio"), odds.alias("odds_ratio"))
    # compared in whole numbers where it matters: n_ab * n >= min_ratio * n_a * n_b
    return out.where(d("n_ab") * F.col("n") >= F.lit(float(min_ratio)) * (d("n_a") * d("n_b")))
