"""Clusters of similar sequences, and superposition of structures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators.greedy import greedy_picks
from foldloom.scratch import cut


WORD_ROWS = 4096  # rows of one word that are met in one task
BLOCK = 1024  # rows of a family compared with as many others in one task


def _with_text(df: DataFrame, group: str | None, key: str, text: Column, length: Column) -> tuple[DataFrame, DataFrame]:
    """One row (g, id, text, len) for each different text of a group, under its smallest id; and g, id, first of all rows.

    Rows of equal text are decided alike by a pass in order of (length, id), so only the first of them takes part in it.
    """
    g = F.col(group) if group else F.lit(0)
    rows = df.select(g.alias("g"), F.col(key).alias("id"), text.alias("text"), length.alias("len")).where("g is not null and id is not null and len > 0")
    rows = cut(rows.groupBy("g", "id").agg(F.max(F.struct("len", "text")).alias("x")).select("g", "id", "x.text", "x.len"), "sequences")
    one = cut(rows.groupBy("g", "text").agg(F.min("id").alias("id"), F.max("len").alias("len")), "texts")
    return one, rows.join(one.select("g", "text", F.col("id").alias("first")), ["g", "text"]).select("g", "id", "first")


def _candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """id, centre: all pairs of rows (id, words) that can share `similarity` of the words of the row with fewer.

    Such a pair shares ceil(similarity * size) words of the smaller row, so it shares one of any size - that + 1 of them;
    these are taken from the rarest words. Frequent words are met in parts.
    """
    each = rows.select("id", F.size("words").alias("size"), F.explode("words").alias("word"))
    each = cut(each.join(each.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "word", "left").withColumn("n", F.coalesce("n", F.lit(1))), "words")
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "word"))
    parts = F.ceil(F.col("n") / WORD_ROWS)
    few = each.withColumn("place", place).where((F.col("n") > 1) & (F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size")) + 1))
    few = few.select("id", "size", "word", F.pmod(F.xxhash64("id"), parts).alias("part"))
    other = each.where("n > 1").select(F.col("id").alias("centre"), F.col("size").alias("centre_size"), "word", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    met = few.join(other, ["word", "part"]).where("size < centre_size or size = centre_size and id <> centre")
    return met.select("id", "centre").distinct()


def _representatives(rows: DataFrame, every: DataFrame, alike: DataFrame, key: str) -> DataFrame:
    """key and representative: the longest pick first and take those alike."""
    nodes = rows.select("g", "id", (-F.col("len")).alias("rank"))
    picks = greedy_picks(nodes, alike.select("g", F.col("id").alias("a"), F.col("centre").alias("b")), "g", "id", "rank")
    return every.join(picks.withColumnRenamed("id", "first"), ["g", "first"]).select(F.col("id").alias(key), F.col("head").alias("representative"))


def sequence_clusters(df: DataFrame, key: str, sequence: str, k: int = 5, similarity: float = 0.5) -> DataFrame:
    """key and representative of each sequence with at least one word of length k; others have no row.

    A pair counts if it shares at least `similarity` of the words of the shorter (the one with fewer). All such pairs are
    found (see _candidates). Then the longest sequences (ties: the smallest key) pick first, and take those similar to them.
    """
    text = F.upper(F.col(sequence))
    rows, every = _with_text(df.where(F.length(sequence) >= k), None, key, text, F.length(sequence))
    starts = F.sequence(F.lit(1), F.length("text") - k + 1)
    words = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substr("text", i, F.lit(k)))))
    rows = cut(rows.select("g", "id", "len", words.alias("words")), "words")
    own = rows.select("g", "id", F.col("words").alias("a"))
    other = rows.select(F.col("id").alias("centre"), F.col("words").alias("b"))
    both = _candidates(rows, similarity).join(own, "id").join(other, "centre")
    alike = both.where(F.size(F.array_intersect("a", "b")) >= similarity * F.least(F.size("a"), F.size("b")))
    return _representatives(rows, every, alike, key)


def _codes(texts: pd.Series) -> np.ndarray:
    """Letters as numbers, a row for each text, short ones filled up; gaps and what is filled up are 0."""
    width = int(texts.str.len().max())
    codes = np.frombuffer("".join(texts.str.ljust(width, "-")).encode("utf-32-le"), np.uint32).reshape(len(texts), width)
    return np.where((codes == ord("-")) | (codes == ord(".")), 0, codes)


def _alike_pairs(rows: DataFrame, identity: float) -> DataFrame:
    """g, id, centre: all pairs of a group with the same residue in at least `identity` of the columns where both have one.

    Each row goes to every pair of blocks of its group that holds its own; a task compares the rows of two blocks.
    """
    blocks = rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    own = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")))
    pairs = own.select("g", "id", "text", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("met"))
    pairs = pairs.select("g", "id", "text", "own", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"))

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        lo = (t.own == t.lo).to_numpy()
        codes, same = _codes(t.text), np.float32(0)
        a, b = codes[lo], codes if lo.all() else codes[~lo]
        for letter in np.unique(codes[codes > 0]):
            same = same + (a == letter).astype(np.float32) @ (b == letter).astype(np.float32).T
        n = (a > 0).astype(np.float32) @ (b > 0).astype(np.float32).T
        alike = (n > 0) & (same >= identity * n.astype(float))
        i, j = np.nonzero(np.triu(alike, 1) if lo.all() and t.lo.iat[0] == t.hi.iat[0] else alike)
        ids = t.id.to_numpy()
        return pd.DataFrame({"g": t.g.iat[0], "id": ids[lo][i], "centre": (ids if lo.all() else ids[~lo])[j]})

    kinds = dict(rows.dtypes)
    return pairs.groupBy("g", "lo", "hi").applyInPandas(compare, f"g {kinds['g']}, id {kinds['id']}, centre {kinds['id']}")


def non_redundant(df: DataFrame, family: str, key: str, aln: str, identity: float = 0.8) -> DataFrame:
    """key and representative of each aligned row with a residue: in a family the row with most residues (ties: the smallest
    key) picks first, and takes those that have the same residue as it in at least `identity` of the columns where both
    have one. All rows of a family are compared.
    """
    rows, every = _with_text(df, family, key, F.upper(F.col(aln)), F.length(F.regexp_replace(aln, "[.-]", "")))
    return _representatives(rows, every, cut(_alike_pairs(rows, identity), "alike"), key)


def identity_ladder(df: DataFrame, family: str, key: str, aln: str, identities: tuple[float, ...] = (0.8, 0.85, 0.9, 0.95, 1.0)) -> DataFrame:
    """key, representative and identity: non_redundant at the first identity; families left with one representative are done
    again at the next one, until they have more or the last one is reached."""
    left, done = df, None
    for k, identity in enumerate(identities):
        found = non_redundant(left, family, key, aln, identity)
        named = left.select(F.col(key), F.col(family).alias("_family"))
        found = cut(found.join(named, key).withColumn("identity", F.lit(identity)), "ladder")
        single = found.groupBy("_family").agg(F.countDistinct("representative").alias("n"), F.count("*").alias("rows")).where("n = 1 and rows > 1").select("_family")
        if k + 1 < len(identities):
            single = cut(single, "single")
            settled = found.join(single, "_family", "left_anti")
            left = left.join(single.withColumnRenamed("_family", family), family, "left_semi")
        else:
            settled = found
        part = settled.select(key, "representative", "identity")
        done = part if done is None else done.unionByName(part)
        if k + 1 < len(identities) and single.isEmpty():
            break
    return done


def superposed(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, n, rmsd and rotation (nine numbers, by rows) that lays the points x2, y2, z2 best on x, y, z.

    Spark sums the products of coordinates; only a 3 x 3 matrix of each key goes to Python.
    """
    axes, other = ("x", "y", "z"), ("x2", "y2", "z2")
    sums = {f"s_{c}": F.sum(c) for c in (*axes, *other)} | {f"p_{a}_{b}": F.sum(F.col(a) * F.col(b)) for a in axes for b in other}
    sums |= {"squares": F.sum(sum((F.col(c) * F.col(c) for c in (*axes, *other)), F.lit(0.0)))}
    rows = pairs.groupBy(*key).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            n = t.n.to_numpy(float)
            h = np.stack([np.stack([t[f"p_{a}_{b}"] - t[f"s_{a}"] * t[f"s_{b}"] / n for a in axes], axis=-1) for b in other], axis=-2)
            u, s, vt = np.linalg.svd(h)
            sign = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
            s[:, 2] *= sign
            vt[:, 2] *= sign[:, None]
            spread = t.squares - sum(t[f"s_{c}"] ** 2 for c in (*axes, *other)) / n
            rmsd = np.sqrt(np.maximum(0, spread - 2 * s.sum(axis=1)) / n)
            rotation = np.swapaxes(u @ vt, 1, 2).reshape(len(t), 9)
            yield t[key].assign(n=t.n, rmsd=rmsd, rotation=list(rotation))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(solve, f"{', '.join(f'{c} {kinds[c]}' for c in key)}, n bigint, rmsd double, rotation array<double>")
