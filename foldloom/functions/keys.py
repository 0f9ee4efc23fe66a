"""How the tables write accessions, and what they mean by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def accession(col: str | Column) -> Column:
    """Bare accession: without version and surrounding blanks, in capitals; null where nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.upper(F.btrim(F.substring_index(c, ".", 1), F.lit(BLANKS)))
    return F.when(F.length(bare) > 0, bare)
