"""Work lists and flat-file records of curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed format of an overlap detail: `[CL:]FAM n(size)`
DETAIL = r"^(?:(CL\d+):)?([A-Za-z0-9_]+)\s+(\d+)\((\d+)\)$"
# fixed lists of the flat-file filter
KEPT_DATABASES = ("STRING", "InterPro", "Pfam", "SMART", "Gene3D")
DROPPED_FEATURES = ("COMPBIAS", "MOD_RES", "VAR_SEQ", "CONFLICT", "VARIANT", "HELIX", "STRAND", "TURN")
DROPPED_REFERENCES = ("NUCLEOTIDE SEQUENCE", "LARGE SCALE ANALYSIS", "TISSUE SPECIFICITY")
REFERENCE_TAGS = ("RP", "RC", "RX", "RG", "RA", "RT", "RL")


def overlap_details(df: DataFrame, detail: str) -> DataFrame:
    """Clan (null if none), family, overlap count and family size of `[CL:]FAM n(size)`."""
    part = lambda k: F.regexp_extract(detail, DETAIL, k)
    clan = part(1)
    return df.where(F.col(detail).rlike(DETAIL)).withColumns(
        {"clan": F.when(clan != "", clan), "family": part(2), "n_common": part(3).cast("bigint"), "size": part(4).cast("bigint")}
    )


def resolution_eligibility(details: DataFrame, key: str) -> DataFrame:
    """Whether the overlaps of a key may be resolved: one family, or all families in one clan."""
    rows = details.groupBy(key).agg(
        F.countDistinct("family").alias("n_families"), F.countDistinct("clan").alias("n_clans"), F.bool_or(F.col("clan").isNull()).alias("clanless"), F.min("clan").alias("clan")
    )
    one_clan = (F.col("n_clans") == 1) & ~F.col("clanless")
    reason = (
        F.when((F.col("n_families") == 1), "single family")
        .when(F.col("clanless"), "some without clan")
        .when(one_clan, "one clan")
        .otherwise("different clans")
    )
    eligible = (F.col("n_families") == 1) | one_clan
    return rows.select(key, "n_families", eligible.alias("eligible"), reason.alias("reason"), F.when(eligible, F.col("clan")).alias("clan"))


def merge_gains(details: DataFrame, key: str, gained: str) -> DataFrame:
    """Keys with exactly one overlapping family of which they'd gain at least a tenth, with the ratio."""
    rows = details.groupBy(key).agg(F.countDistinct("family").alias("n"), F.min("family").alias("family"), F.max("size").alias("size"), F.max(gained).alias("gained"))
    rows = rows.where("n = 1 and size > 0").where("gained * 10 >= size")
    return rows.select(key, "family", "gained", "size", F.round(F.col("gained") / F.col("size"), 6).alias("ratio"))


def filter_flat_file(lines: DataFrame, key: str, place: str, line: str) -> DataFrame:
    """The lines of an entry without references of no interest, other databases' cross references and features that
    say nothing about domains.

    Lines are numbered by place within key. A reference block runs from RN to the line before another tag; a feature
    from its first line over its continuation lines.
    """
    text = F.col(line)
    tag = F.substring(text, 1, 2)
    by = Window.partitionBy(key).orderBy(place)
    feature = tag == "FT"
    continued = feature & (F.substring(text, 6, 1) == " ")
    starts = ~((tag.isin(*REFERENCE_TAGS)) | continued)
    rows = lines.withColumns({"_tag": tag, "_starts": starts.cast("int")})
    rows = rows.withColumn("_block", F.sum("_starts").over(by))
    block = Window.partitionBy(key, "_block")
    first = F.first("_tag").over(block.orderBy(place))
    bad = (F.col("_tag") == "RP") & (text.rlike("|".join(DROPPED_REFERENCES)) | text.startswith("RP   VARIANT"))
    kind = F.first(F.regexp_extract(text, r"^FT   (\S+)", 1)).over(block.orderBy(place))
    rows = rows.withColumns({"_first": first, "_bad": F.bool_or(bad).over(block), "_kind": kind, "_disordered": F.bool_or(text.contains("Disordered")).over(block)})
    database = F.btrim(F.split_part(F.substr(text, F.lit(6)), F.lit(";"), F.lit(1)))
    drop = (
        ((F.col("_first") == "RN") & F.col("_bad"))
        | ((F.col("_tag") == "DR") & ~database.isin(*KEPT_DATABASES))
        | ((F.col("_first") == "FT") & (F.col("_kind").isin(*DROPPED_FEATURES) | ((F.col("_kind") == "REGION") & F.col("_disordered"))))
    )
    return rows.where(~F.coalesce(drop, F.lit(False))).drop("_tag", "_starts", "_block", "_first", "_bad", "_kind", "_disordered")


def set_tag(record: str, tag: str, value, after: str):
    """Column: the piped record with its line of tag replaced, or put behind the line `after` if it has none."""
    lines = F.split(record, r"\|")
    new = F.concat(F.lit(f"{tag}   "), value)
    has = F.exists(lines, lambda x: x.startswith(tag))
    replaced = F.transform(lines, lambda x: F.when(x.startswith(tag), new).otherwise(x))
    added = F.flatten(F.transform(lines, lambda x: F.when(x.startswith(after), F.array(x, new)).otherwise(F.array(x))))
    return F.array_join(F.when(has, replaced).otherwise(added), "|")


def without_tag(record: str, tag: str):
    """Column: the piped record without its lines of tag."""
    return F.array_join(F.filter(F.split(record, r"\|"), lambda x: ~x.startswith(tag)), "|")


def rewrite_seed_source(record: str, prefix: str):
    """Column: the piped record with the source of its seed under another prefix, without the mark of an iteration."""
    new = lambda x: F.concat(F.lit(f"SE   {prefix}:"), F.replace(F.substr(x, F.locate(":", x) + 1), F.lit("/Iterate"), F.lit("")))
    return F.array_join(F.transform(F.split(record, r"\|"), lambda x: F.when(x.startswith("SE ") & x.contains(":"), new(x)).otherwise(x)), "|")


def is_frozen(record: str):
    """Column: whether a flag of the piped record forbids iteration."""
    # fixed forms of the flags
    return F.exists(F.split(record, r"\|"), lambda x: x.startswith("**   DNI") | x.startswith("**   HT"))


def newer_than(source: DataFrame, target: DataFrame, key: str, changed: str) -> DataFrame:
    """Rows of source that target lacks or holds in an older state."""
    known = target.select(key, F.col(changed).alias("_known"))
    return source.join(known, key, "left").where(F.col("_known").isNull() | (F.col(changed) > F.col("_known"))).drop("_known")


def sample_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows with the smallest hash of key: the same rows in every run."""
    return df.withColumn("_h", F.md5(F.col(key).cast("string"))).orderBy("_h", key).limit(n).drop("_h")
