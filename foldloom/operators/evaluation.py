"""Predicted domains against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators.intervals import overlap_join
from foldloom.scratch import Pile, cut


def iou_pairs(true: DataFrame, pred: DataFrame) -> DataFrame:
    """prot, t, p, iou of true and predicted domains (prot, dom, s, e: one row for each segment; segments of a domain
    don't overlap) that share a residue."""
    size = lambda df, name: df.groupBy("prot", "dom").agg(F.sum(F.col("e") - F.col("s") + 1).alias(f"len_{name}")).withColumnRenamed("dom", name)
    a = true.select("prot", F.col("dom").alias("t"), F.col("s").alias("ts"), F.col("e").alias("te"))
    b = pred.select("prot", F.col("dom").alias("p"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    common = F.least("te", "pe") - F.greatest("ts", "ps") + 1
    met = overlap_join(a, b, "prot", "ts", "te", "ps", "pe").groupBy("prot", "t", "p").agg(F.sum(common).alias("common"))
    rows = met.join(size(true, "t"), ["prot", "t"]).join(size(pred, "p"), ["prot", "p"])
    return rows.select("prot", "t", "p", (F.col("common") / (F.col("len_t") + F.col("len_p") - F.col("common"))).alias("iou"), "len_t")


def matched(pairs: DataFrame) -> DataFrame:
    """One-to-one matches, best pair first (ties: smallest t, then p).

    A pair that is the best both of its true and of its predicted domain is what the greedy choice takes in any case;
    so all such pairs are taken at once in all proteins, their domains leave, and it goes on until no pair is left.
    """
    left = cut(pairs.select("prot", "t", "p", "iou"), "pairs")
    pile = Pile(left, "found")
    rank = F.struct("iou", (-F.col("t")).alias("mt"), (-F.col("p")).alias("mp"))
    by_t, by_p = Window.partitionBy("prot", "t"), Window.partitionBy("prot", "p")
    while not left.isEmpty():
        rows = left.withColumn("rank", rank).withColumn("bt", F.max("rank").over(by_t)).withColumn("bp", F.max("rank").over(by_p))
        rows = rows.withColumn("taken", (F.col("bt") == F.col("rank")) & (F.col("bp") == F.col("rank")))
        rows = rows.withColumn("used_p", F.max("taken").over(by_p)).withColumn("used_t", F.max("taken").over(by_t))
        step = cut(rows.where("taken or not (used_p or used_t)").select("prot", "t", "p", "iou", "taken"), "pairs")
        pile.add(step.where("taken"))
        left = step.where("not taken").drop("taken")
    return pile.rows()


def protein_scores(true: DataFrame, pred: DataFrame, matches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Of each protein: numbers of domains, length-weighted IoU, score, status and class of error."""
    t = true.groupBy("prot", "dom").agg(F.sum(F.col("e") - F.col("s") + 1).alias("len"))
    n_true = t.groupBy("prot").agg(F.count("*").alias("n_true"), F.sum("len").alias("len"))
    n_pred = pred.groupBy("prot").agg(F.countDistinct("dom").alias("n_pred"))
    good = matches.join(t.withColumnRenamed("dom", "t"), ["prot", "t"]).groupBy("prot").agg(F.sum(F.col("iou") * F.col("len")).alias("hit"), F.count_if(F.col("iou") >= threshold).alias("n_good"))
    rows = n_true.join(n_pred, "prot", "full").join(good, "prot", "left").fillna(0, ["n_true", "n_pred", "hit", "n_good"])
    weighted = F.when(F.col("n_true") == 0, F.lit(1.0)).otherwise(F.col("hit") / F.when(F.col("n_true") > 0, F.col("len")))
    count_score = F.greatest(F.lit(0.0), 1 - F.abs(F.col("n_pred") - F.col("n_true")) / F.greatest("n_true", F.lit(1)))
    rows = rows.withColumn("weighted_iou", weighted).withColumn("score", 0.7 * F.col("weighted_iou") + 0.3 * count_score)
    return rows.select("prot", "n_true", "n_pred", "n_good", "weighted_iou", "score", status(F.col("score")).alias("status"), error_class().alias("error"))


def status(score: Column) -> Column:
    # fixed values: the steps of the status
    return F.when(score >= 0.9, "GOOD").when(score >= 0.7, "OK").otherwise("BAD")


def error_class() -> Column:
    t, p, g = F.col("n_true"), F.col("n_pred"), F.col("n_good")
    # fixed values: the names of the classes
    return (
        F.when((t == 0) & (p == 0), "no_domains_correct")
        .when(t == 0, "false_positive")
        .when(p == 0, "false_negative")
        .when((g == t) & (g == p), "correct")
        .when(p < t, "under_split")
        .when(p > t, "over_split")
        .otherwise("boundary_error")
    )


def boundary_f1(true: DataFrame, pred: DataFrame, tolerances: list[int]) -> DataFrame:
    """tolerance, tp, fp, fn, f1 of domain ends; an end is found if one of the other side lies within the tolerance.
    Hits are counted on the true side, false ones on the predicted side."""
    ends = lambda df: df.select("prot", F.explode(F.array("s", "e")).alias("b")).distinct()
    widest = max(tolerances)

    def nearest(own: DataFrame, other: DataFrame) -> DataFrame:
        span = own.withColumns({"lo": F.col("b") - widest, "hi": F.col("b") + widest})
        points = other.select("prot", F.col("b").alias("o"), F.col("b").alias("o_end"))
        near = overlap_join(span, points, "prot", "lo", "hi", "o", "o_end").groupBy("prot", "b").agg(F.min(F.abs(F.col("b") - F.col("o"))).alias("d"))
        return own.join(near, ["prot", "b"], "left").select(F.explode(F.array(*map(F.lit, tolerances))).alias("tolerance"), "d")

    a, b = ends(true), ends(pred)
    hit = (F.col("d") <= F.col("tolerance")) & F.col("d").isNotNull()
    found = nearest(a, b).groupBy("tolerance").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"))
    rows = found.join(nearest(b, a).groupBy("tolerance").agg(F.count_if(~hit).alias("fp")), "tolerance")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    f1 = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.when(F.col("tp") > 0, precision + recall))
    return rows.select("tolerance", "tp", "fp", "fn", f1.alias("f1"))
