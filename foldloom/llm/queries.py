"""The registered queries of problems 2, 3, 7, 8 and 9, with their SQL where SQL can say it."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions.keys import accession
from foldloom.llm.components import group_linked
from foldloom.llm.cooccurrence import count_pairs
from foldloom.llm.packing import pack_corpus
from foldloom.llm.pii import mask_pii
from foldloom.llm.tokens import encode_corpus
from foldloom.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "family_hits").select(accession("query_family").alias("query"), accession("target_family").alias("target"))
    return group_linked(hits, "query", "target").select(F.col("record").alias("family"), F.col("group_id").alias("group_family"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "region_hits").select(accession("id").alias("id"), accession("family").alias("family"))
    pairs = count_pairs(hits, "id", "family", min_count=6, min_ratio=20)
    return pairs.select(F.col("item_a").alias("family_a"), F.col("item_b").alias("family_b"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack_corpus(table(spark, folder, "documents"), "doc_id", "text")


def _pii_key(spark: SparkSession) -> bytes:
    """The key in foldloom.pii.key, in hexadecimal digits; without one a new key, so that no run is linked with another."""
    given = spark.conf.get("foldloom.pii.key", None)
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The spans that got a placeholder."""
    cases = mask_pii(table(spark, folder, "documents"), "doc_id", "text", _pii_key(spark)).select("doc_id", F.explode("found").alias("x"))
    return cases.where("x.placeholder is not null").select("doc_id", "x.pii_type", "x.pii_text").distinct()


def p9_masked(spark: SparkSession, folder: str) -> DataFrame:
    return mask_pii(table(spark, folder, "documents"), "doc_id", "text", _pii_key(spark)).select("doc_id", "masked")


_ACC = "nullif(upper(trim(split_part({0}, '.', 1), ' ' || chr(9) || chr(10) || chr(13))), '')"

ORACLES = {
    "p2_found": f"""
with recursive h as (select {_ACC.format("query_family")} as a, {_ACC.format("target_family")} as b from family_hits),
v as (select a as f from h where a is not null union select b from h where b is not null),
e as (select distinct a, b from (select a, b from h union all select b, a from h) where a is not null and b is not null and a <> b),
reach as (select f, f as g from v union select r.f, e.b from reach r join e on e.a = r.g)
select f as family, min(g) as group_family from reach group by f""",
    "p3_found": f"""
with b as (select distinct {_ACC.format("id")} as i, {_ACC.format("family")} as f from region_hits),
k as (select i, f from b where i is not null and f is not null),
n as (select count(distinct i) as n from k),
c as (select f, count(*) as n_f from k group by f),
p as (select x.f as a, y.f as b, count(*) as n_ab from k x join k y on x.i = y.i and x.f < y.f group by x.f, y.f having count(*) >= 6)
select p.a as family_a, p.b as family_b from p join c ca on ca.f = p.a join c cb on cb.f = p.b cross join n where p.n_ab * n.n >= 20 * ca.n_f * cb.n_f""",
}

QUERIES = {f.__name__: f for f in (p2_found, p3_found, p7_ids, p8_containers, p9_found, p9_masked)}
