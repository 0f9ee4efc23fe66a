"""Columns over inclusive residue intervals and over choppings such as `11-41_290-389`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segments(chopping: Name) -> Column:
    """Segments (s, e) of one domain; malformed ones are left out; an empty array for null, '' and '-'."""
    parts = F.filter(F.split(F.coalesce(_c(chopping), F.lit("")), "_"), lambda x: x.rlike(r"^\d+-\d+$"))
    return F.transform(
        parts,
        lambda x: F.struct(
            F.split_part(x, F.lit("-"), F.lit(1)).cast("bigint").alias("s"), F.split_part(x, F.lit("-"), F.lit(2)).cast("bigint").alias("e")
        ),
    )


def domains(choppings: Name) -> Column:
    """Domains of a protein, each an array of segments: commas part domains."""
    parts = F.filter(F.split(F.coalesce(_c(choppings), F.lit("")), ","), lambda x: x.rlike(r"\d+-\d+"))
    return F.transform(parts, segments)


def chopping(segs: Name) -> Column:
    """Segments written as a chopping."""
    return F.array_join(F.transform(_c(segs), lambda x: F.concat_ws("-", x["s"], x["e"])), "_")


def total_length(segs: Name) -> Column:
    return F.aggregate(_c(segs), F.lit(0).cast("bigint"), lambda n, x: n + x["e"] - x["s"] + 1)


def span_start(segs: Name) -> Column:
    return F.array_min(F.transform(_c(segs), lambda x: x["s"]))


def span_end(segs: Name) -> Column:
    return F.array_max(F.transform(_c(segs), lambda x: x["e"]))


def overlap(s1: Name, e1: Name, s2: Name, e2: Name) -> Column:
    """Residues in both intervals; a shared end counts as one."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)) + 1)


def segments_overlap(segs: Name, s: Name, e: Name) -> Column:
    """Residues of all segments in [s, e]."""
    start, end = _c(s), _c(e)
    return F.aggregate(_c(segs), F.lit(0).cast("bigint"), lambda n, x: n + overlap(x["s"], x["e"], start, end))


def overlap_percent(s: Name, e: Name, s2: Name, e2: Name) -> Column:
    """Share of [s, e] that lies in [s2, e2], in percent."""
    return overlap(s, e, s2, e2) * 100.0 / (_c(e) - _c(s) + 1)


def shorter_fraction(s1: Name, e1: Name, s2: Name, e2: Name) -> Column:
    """Overlap by the shorter of two intervals; intervals that share no more than an end have none."""
    a, b = F.greatest(_c(s1), _c(s2)), F.least(_c(e1), _c(e2))
    short = F.least(_c(e1) - _c(s1) + 1, _c(e2) - _c(s2) + 1)
    return F.when(a >= b, F.lit(0.0)).otherwise((b - a + 1) / short)


def midpoint_inside(s1: Name, e1: Name, s2: Name, e2: Name) -> Column:
    """Whether the middle of either interval lies strictly within the other; in doubled whole numbers."""
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    m1, m2 = s1 + e1, s2 + e2
    return (s1 <= e2) & (s2 <= e1) & (((m1 > 2 * s2) & (m1 < 2 * e2)) | ((m2 > 2 * s1) & (m2 < 2 * e1)))


def residue_overlap(s1: Name, e1: Name, s2: Name, e2: Name) -> Column:
    """Overlap by cases: apart, nested, or end over start."""
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    return (
        F.when((e1 < s2) | (e2 < s1), F.lit(0).cast("bigint"))
        .when((s1 >= s2) & (e1 <= e2), e1 - s1 + 1)
        .when((s2 >= s1) & (e2 <= e1), e2 - s2 + 1)
        .when(s1 < s2, e1 - s2 + 1)
        .otherwise(e2 - s1 + 1)
    )


def boundary_similarity(b1: Name, b2: Name, tolerance: int) -> Column:
    """1 for equal boundaries, falling to 0 at the tolerance."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(_c(b1) - _c(b2)) / F.lit(float(tolerance)))


def with_spans(df: DataFrame, chopping: str) -> DataFrame:
    """df with segs, their outer span_s and span_e, and their total length d_len; rows without a segment are left out.

    Both steps generate one row from one, which keeps Catalyst from repeating the parse in every later expression.
    """
    parsed = df.select("*", F.explode(F.array(segments(chopping))).alias("segs")).where(F.size("segs") > 0)
    spans = F.struct(span_start("segs").alias("span_s"), span_end("segs").alias("span_e"), total_length("segs").alias("d_len"))
    return parsed.select("*", F.inline(F.array(spans)))
