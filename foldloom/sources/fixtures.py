"""Views in the shape of domain annotation data over the general tables, for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.sources.tables import table


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """All domain hits on proteins."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_partkey as acc",
        "l_suppkey as fam",
        "l_linenumber as ln",
        "l_orderkey as okey",
        "l_linestatus as src",
        "l_returnflag as cath",
        "cast(floor(l_extendedprice) as bigint) % 400 + 1 as s",
        "cast(floor(l_extendedprice) as bigint) % 400 + cast(floor(l_quantity) as bigint) + 20 as e",
        "l_discount * 0.01D as evalue",
    )


def structure_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Structure domains with their chopping; every second has two segments."""
    return hits(spark, folder).where("src = 'F'").selectExpr(
        "okey",
        "ln",
        "acc",
        "fam",
        "cath",
        "case when ln % 2 = 1 then concat_ws('-', s, e) else concat(s, '-', s + 9, '_', s + 15, '-', e) end as chopping",
        "case when ln % 3 = 0 then 'high' when ln % 3 = 1 then 'medium' else 'low' end as consensus_level",
    )


def family_regions(spark: SparkSession, folder: str) -> DataFrame:
    return hits(spark, folder).where("src = 'O'").selectExpr("okey", "ln", "acc", "s as seq_start", "e as seq_end", "fam", "evalue")


def clans(spark: SparkSession, folder: str) -> DataFrame:
    """Families with their clan, if they have one."""
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey as fam", "case when s_nationkey % 5 = 0 then null else s_nationkey end as clan_acc", "s_name as fam_id"
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Interaction edges between proteins, by species."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_suppkey as p1", "l_partkey as p2", "l_linenumber as taxid", "cast(floor(l_extendedprice) as bigint) % 1000 as score"
    )


ALIGNED_LINE = r'^"?([A-Z0-9]+)\.([0-9]+)/([0-9]+)-([0-9]+)"?[ \t]+([A-Za-z.-]+)\s*$'


def alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment rows: accession, its first and last residue, and the aligned sequence."""
    rows = table(spark, folder, "alignment_lines").where(F.col("raw_line").rlike(ALIGNED_LINE))
    part = lambda k: F.regexp_extract("raw_line", ALIGNED_LINE, k)
    return rows.select("line_id", "family", part(1).alias("acc"), part(3).cast("bigint").alias("first"), part(4).cast("bigint").alias("last"), part(5).alias("aln"))


PROTEIN_VECTORS = 2_000  # vectors of all labels that make the residues of one protein for each label


def residues(spark: SparkSession, folder: str) -> DataFrame:
    """Residues of proteins: index, CA coordinates, confidence. A protein is a label within a stretch of vectors, so a larger
    table has more proteins, not longer ones."""
    prot = F.expr(f"cast(label + 10 * (vec_id div {PROTEIN_VECTORS}) as int)")
    at = Window.partitionBy(prot).orderBy("vec_id")
    axis = [F.col("embedding")[k].cast("double") for k in range(4)]
    return table(spark, folder, "embeddings").select(
        prot.alias("prot"),
        F.row_number().over(at).alias("idx"),
        (axis[0] * 100).alias("x"),
        (axis[1] * 100).alias("y"),
        (axis[2] * 100).alias("z"),
        F.least(F.lit(100.0), F.abs(axis[3]) * 800).alias("plddt"),
    )


def triage(spark: SparkSession, folder: str) -> DataFrame:
    """The curation work list."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as okey",
        "o_custkey as root",
        "o_orderkey % 4 as depth",
        "cast(floor(o_totalprice) as bigint) % 5000 + 1 as total_seqs",
        "case when o_orderkey % 3 = 0 then 0 else cast(floor(o_totalprice) as bigint) % 200 end as n_overlap",
        "case when o_orderkey % 5 = 0 then 0 else o_orderkey % 11 end as swissprot",
        "concat(case when o_orderkey % 2 = 0 then concat('CL000', o_custkey % 3, ':') else '' end, 'Fam', o_custkey % 7, ' ', o_orderkey % 50, '(', o_orderkey % 900 + 1, ')') as detail",
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted domains by protein and method."""
    return table(spark, folder, "events").where("value is not null").selectExpr(
        "user_id as prot",
        "event_type as method",
        "cast(floor(value) as bigint) % 300 + 1 as s",
        "cast(floor(value) as bigint) % 300 + 40 + event_id % 60 as e",
        "event_id",
        "cast(ts as date) as day",
    )


def tagged_records(spark: SparkSession, folder: str) -> DataFrame:
    """Flat-file records, their tagged lines joined by a pipe."""
    return table(spark, folder, "documents").where("text is not null").selectExpr(
        "doc_id",
        "concat('ID   D', doc_id, '|DE   ', regexp_replace(text, '[^A-Za-z]', ' '), '|TP   ',"
        " case when n_chars % 3 = 0 then 'Domain' when n_chars % 3 = 1 then 'Family' else 'Repeat' end,"
        " '|RN   [1]|RM   ', 1000000 + n_chars, '|CC   ', coalesce(lang, '')) as rec",
    )


SQL = {
    "fx_region": """select l_partkey as acc, l_suppkey as fam, l_linenumber as ln, l_orderkey as okey, l_linestatus as src, l_returnflag as cath,
  cast(floor(l_extendedprice) as bigint) % 400 + 1 as s, cast(floor(l_extendedprice) as bigint) % 400 + cast(floor(l_quantity) as bigint) + 20 as e,
  l_discount * 0.01::double as evalue from lineitem""",
    "fx_ted": """select okey, ln, acc, fam, cath, case when ln % 2 = 1 then concat(s, '-', e) else concat(s, '-', s + 9, '_', s + 15, '-', e) end as chopping,
  case when ln % 3 = 0 then 'high' when ln % 3 = 1 then 'medium' else 'low' end as consensus_level from fx_region where src = 'F'""",
    "fx_family": "select okey, ln, acc, s as seq_start, e as seq_end, fam, evalue from fx_region where src = 'O'",
    "fx_clan": "select s_suppkey as fam, case when s_nationkey % 5 = 0 then null else s_nationkey end as clan_acc, s_name as fam_id from supplier",
    "fx_links": "select l_suppkey as p1, l_partkey as p2, l_linenumber as taxid, cast(floor(l_extendedprice) as bigint) % 1000 as score from lineitem",
    "fx_align": f"""select line_id, family, x.acc as acc, cast(x.a as bigint) as first, cast(x.b as bigint) as last, x.aln as aln
  from (select line_id, family, regexp_extract(raw_line, '{ALIGNED_LINE}', ['acc', 'v', 'a', 'b', 'aln']) as x from alignment_lines) where x.acc <> ''""",
    "fx_res": f"""select cast(label + 10 * (vec_id // {PROTEIN_VECTORS}) as integer) as prot, cast(row_number() over (partition by label + 10 * (vec_id // {PROTEIN_VECTORS}) order by vec_id) as integer) as idx, cast(embedding[1] as double) * 100 as x,
  cast(embedding[2] as double) * 100 as y, cast(embedding[3] as double) * 100 as z,
  least(100.0::double, abs(cast(embedding[4] as double)) * 800) as plddt from embeddings""",
    "fx_triage": """select o_orderkey as okey, o_custkey as root, o_orderkey % 4 as depth, cast(floor(o_totalprice) as bigint) % 5000 + 1 as total_seqs,
  case when o_orderkey % 3 = 0 then 0 else cast(floor(o_totalprice) as bigint) % 200 end as n_overlap,
  case when o_orderkey % 5 = 0 then 0 else o_orderkey % 11 end as swissprot,
  concat(case when o_orderkey % 2 = 0 then concat('CL000', o_custkey % 3, ':') else '' end, 'Fam', o_custkey % 7, ' ', o_orderkey % 50, '(', o_orderkey % 900 + 1, ')') as detail
  from orders""",
    "fx_pred": """select user_id as prot, event_type as method, cast(floor(value) as bigint) % 300 + 1 as s, cast(floor(value) as bigint) % 300 + 40 + event_id % 60 as e, event_id, cast(ts as date) as day
  from events where value is not null""",
    "fx_desc": """select doc_id, concat('ID   D', doc_id, '|DE   ', regexp_replace(text, '[^A-Za-z]', ' ', 'g'), '|TP   ',
  case when n_chars % 3 = 0 then 'Domain' when n_chars % 3 = 1 then 'Family' else 'Repeat' end, '|RN   [1]|RM   ', 1000000 + n_chars, '|CC   ', coalesce(lang, '')) as rec
  from documents where text is not null""",
}
NEEDS = {"fx_ted": ["fx_region"], "fx_family": ["fx_region"]}


def with_views(sql: str, more: str = "") -> str:
    """sql with the CTEs of the views it names in front; more: further CTEs, 'name as (...), ...'."""
    names: list[str] = []
    for name in SQL:
        if name in sql or name in more:
            names += [n for n in [*NEEDS.get(name, []), name] if n not in names]
    ctes = [f"{n} as ({SQL[n]})" for n in names] + ([more] if more else [])
    return f"with recursive {', '.join(ctes)}\n{sql}" if ctes else sql
