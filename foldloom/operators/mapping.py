"""Structure domains against family regions: matches, counts, confidence, dominance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import intervals as iv
from foldloom.operators.intervals import overlap_join


def matched_both_ways(domains: DataFrame, regions: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """Pairs of a domain (acc, chopping, ...) and a region (acc, seq_start, seq_end, ...) on one protein whose common
    residues, over all segments of the domain, are at least min_overlap of either."""
    met = overlap_join(iv.with_spans(domains, "chopping"), regions, "acc", "span_s", "span_e", "seq_start", "seq_end")
    needed = F.greatest(F.lit(1), min_overlap * F.greatest(F.col("d_len"), F.col("seq_end") - F.col("seq_start") + 1))
    met = met.where(iv.overlap("span_s", "span_e", "seq_start", "seq_end") >= needed)  # cheap, and never less than what the segments share
    met = met.withColumn("common", iv.segments_overlap("segs", "seq_start", "seq_end"))
    return met.where(F.col("common") >= needed).drop("span_s", "span_e", "d_len")


def ranked_list(value: Column, count: Column, most: int | None = None, sep: str = ",", with_count: bool = False) -> Column:
    """Aggregate: values by falling count, then value, as one string; at most `most` of them."""
    ranked = F.sort_array(F.collect_list(F.struct((-count).alias("n"), value.alias("v"))))
    ranked = F.slice(ranked, 1, most) if most else ranked
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["v"], -x["n"]) if with_count else x["v"].cast("string")), sep)


def clan_mapping(counts: DataFrame, clans: DataFrame) -> DataFrame:
    """counts (label, level, fam, n) summed by clan, with the clan's share of the label's rows that have a clan."""
    keys = ["label", "level", "clan_acc"]
    known = counts.join(clans.where("clan_acc is not null"), "fam")
    first = Window.partitionBy(*keys).orderBy(F.desc("n"), "fam")  # Spark keeps three rows of each in every task
    top = known.withColumn("k", F.row_number().over(first)).where("k <= 3").groupBy(*keys).agg(ranked_list(F.col("fam"), F.col("n")).alias("top_families"))
    rows = known.groupBy(*keys).agg(F.sum("n").alias("n_total"), F.count("*").alias("n_families")).join(top, keys)
    share = F.round(F.col("n_total") / F.sum("n_total").over(Window.partitionBy("label", "level")), 4)  # one row for each clan
    return rows.withColumn("confidence", share)


def many_label_families(counts: DataFrame, min_labels: int = 2) -> DataFrame:
    """Families with at least min_labels labels, and how far the commonest label dominates."""
    rows = counts.groupBy("fam").agg(
        F.countDistinct("label").alias("n_labels"),
        F.sum("n").alias("n_total"),
        F.round(F.max("n") / F.sum("n"), 6).alias("dominance"),
        ranked_list(F.col("label"), F.col("n"), with_count=True).alias("labels"),
    )
    return rows.where(F.col("n_labels") >= min_labels)
