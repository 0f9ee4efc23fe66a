"""Scores and classes of the annotation work, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: quantiles by confidence; the steps and classes below
Z_OF = {0.95: 1.96, 0.90: 1.645}


def wilson_lower_bound(hits: Column, total: Column, confidence: float = 0.95) -> Column:
    """Lower end of the Wilson interval of a share; 0 without trials."""
    z = Z_OF.get(confidence, 1.96)
    p = hits / total
    centre = p + z * z / (2 * total)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)
    return F.when(total > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / total))).otherwise(F.lit(0.0))


def evalue_class(evalue: Column, strong: float = 1e-10, medium: float = 1e-5) -> Column:
    return F.when(evalue < strong, "strong").when(evalue < medium, "medium").otherwise("weak")


def score_class(score: Column, strong: float = 100, medium: float = 30) -> Column:
    return F.when(score > strong, "strong").when(score >= medium, "medium").otherwise("weak")


def structure_probability(evalue: Column) -> Column:
    """Probability in percent of a structure hit by its E-value, in five pieces."""
    return (
        F.when(evalue < 1e-100, F.lit(100.0))
        .when(evalue < 1e-10, F.lit(99.9))
        .when(evalue < 0.01, 99.0 + (1 - evalue * 100))
        .when(evalue < 1, 90.0 + (1 - evalue) * 9)
        .otherwise(100.0 / (1.0 + evalue))
    )
