"""Curation work lists, flat-file records, literature and sequence texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldloom.functions.keys import accession
from foldloom.operators import curation as cu
from foldloom.operators.networks import first_per_key
from foldloom.plans.registry import Plans
from foldloom.sources import fixtures as fx
from foldloom.sources import lines as tx
from foldloom.sources.tables import table

query = Plans()
QUERIES, ORACLES = query.queries, query.oracles

_DET = """det as (select okey, root, total_seqs, n_overlap, case when detail like 'CL%:%' then split_part(detail, ':', 1) end as clan,
  regexp_extract(detail, '(Fam[0-9]+) ([0-9]+)\\(([0-9]+)\\)', 1) as family, cast(regexp_extract(detail, '(Fam[0-9]+) ([0-9]+)\\(([0-9]+)\\)', 2) as bigint) as n_common,
  cast(regexp_extract(detail, '(Fam[0-9]+) ([0-9]+)\\(([0-9]+)\\)', 3) as bigint) as size from fx_triage)"""


def _details(spark, folder):
    return cu.overlap_details(fx.triage(spark, folder), "detail")


@query("select okey, clan, family, n_common, size from det", _DET)
def p18_overlap_details(spark, folder):
    return _details(spark, folder).select("okey", "clan", "family", "n_common", "size")


@query("select okey, total_seqs, n_overlap, total_seqs - n_overlap as n_free, swissprot, detail from fx_triage")
def s25_triage_lines(spark, folder):
    line = "concat_ws('\\t', concat('d/', root, '/', okey), total_seqs, n_overlap, total_seqs - n_overlap, 'x', '', '', swissprot, detail, okey)"
    rows = fx.triage(spark, folder).select(F.expr(line).alias("line"))
    names = ("dir", "total_seqs", "n_overlap", "n_free", "ratio", "c5", "c6", "swissprot", "detail", "okey")
    kinds = {n: "string" if n in ("dir", "ratio", "c5", "c6", "detail") else "bigint" for n in names}
    return tx.by_delimiter(rows, kinds, needed=("total_seqs",)).select("okey", "total_seqs", "n_overlap", "n_free", "swissprot", "detail")


@query("select okey, concat('root', root) as root, depth + 1 as depth, case when depth > 1 then concat('P', okey) else concat('P', okey, '_X') end as protein from fx_triage")
def p19_path_parts(spark, folder):
    path = F.expr("concat('root', root, repeat('/Iterate', cast(depth as int)), '/P', okey, case when depth > 1 then '_TED01' else '_X' end)")
    rows = fx.triage(spark, folder).select("okey", path.alias("path"))
    leaf = F.element_at(F.split("path", "/"), -1)
    protein = F.when(leaf.rlike("_TED[0-9]+$"), F.regexp_replace(leaf, "_TED[0-9]+$", "")).otherwise(leaf)
    return rows.select("okey", F.split_part("path", F.lit("/"), F.lit(1)).alias("root"), (F.size(F.split("path", "/")) - 1).cast("bigint").alias("depth"), protein.alias("protein"))


@query("select okey, case when n_overlap = 0 then 0 else total_seqs end as n from fx_triage")
def p20_digits_or_zero(spark, folder):
    raw = F.expr("case when n_overlap = 0 then concat(total_seqs, 'x') else cast(total_seqs as string) end")
    return fx.triage(spark, folder).select("okey", F.when(raw.rlike("^[0-9]+$"), raw.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("n"))


@query("select root, okey, total_seqs, swissprot, depth from (select *, row_number() over (partition by root order by total_seqs desc, swissprot desc, depth desc, okey) as k from fx_triage where n_overlap = 0) where k = 1")
def w12_best_per_root(spark, folder):
    free = fx.triage(spark, folder).where("n_overlap = 0")
    best = free.groupBy("root").agg(F.max(F.struct("total_seqs", "swissprot", "depth", (-F.col("okey")).alias("minus"))).alias("x"))
    return best.select("root", (-F.col("x.minus")).alias("okey"), "x.total_seqs", "x.swissprot", "x.depth")


@query("select okey, root, total_seqs, max(total_seqs) over (partition by root) as best_of_root, row_number() over (partition by root order by total_seqs desc, okey) as place from fx_triage")
def w13_group_order(spark, folder):
    by = Window.partitionBy("root")
    place = F.row_number().over(by.orderBy(F.desc("total_seqs"), "okey")).cast("bigint")
    return fx.triage(spark, folder).select("okey", "root", "total_seqs", F.max("total_seqs").over(by).alias("best_of_root"), place.alias("place"))


@query(
    """select root, count(distinct family) as n_families, count(distinct family) = 1 or (count(distinct clan) = 1 and not bool_or(clan is null)) as eligible,
case when count(distinct family) = 1 then 'single family' when bool_or(clan is null) then 'some without clan' when count(distinct clan) = 1 then 'one clan' else 'different clans' end as reason,
case when count(distinct family) = 1 or (count(distinct clan) = 1 and not bool_or(clan is null)) then min(clan) end as clan from det group by root""",
    _DET,
)
def a40_resolution_eligibility(spark, folder):
    return cu.resolution_eligibility(_details(spark, folder), "root")


@query(
    "select root, min(family) as family, max(total_seqs - n_overlap) as gained, max(size) as size, round(max(total_seqs - n_overlap) / max(size), 6) as ratio from det where n_overlap > 0 group by root having count(distinct family) = 1 and max(total_seqs - n_overlap) * 10 >= max(size)",
    _DET,
)
def a41_merge_gains(spark, folder):
    rows = _details(spark, folder).where("n_overlap > 0").withColumn("free", F.col("total_seqs") - F.col("n_overlap"))
    return cu.merge_gains(rows, "root", "free")


@query("select root, count(*) filter (swissprot > 1 and total_seqs > 2500) as n_strict, count(*) filter (swissprot > 9 and n_overlap = 0) as n_loose, count(*) as n from fx_triage group by root")
def p43_quality_predicates(spark, folder):
    rows = fx.triage(spark, folder).groupBy("root")
    return rows.agg(F.count_if(F.expr("swissprot > 1 and total_seqs > 2500")).alias("n_strict"), F.count_if(F.expr("swissprot > 9 and n_overlap = 0")).alias("n_loose"), F.count("*").alias("n"))


@query("select o_orderstatus as state, count(*) as n, count(*) filter (o_orderpriority like '1%') as n_urgent from orders group by o_orderstatus")
def a39_job_states(spark, folder):
    rows = table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("state"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("n_urgent"))


@query(
    """select doc_id, array_to_string([x for x in string_split(rec, '|') if starts_with(x, 'TP')], '') as tp, substr([x for x in string_split(rec, '|') if starts_with(x, 'ID')][1], 6) as id,
cast(substr([x for x in string_split(rec, '|') if starts_with(x, 'RM')][1], 6) as bigint) as pmid, len(string_split(rec, '|')) as n_lines from fx_desc"""
)
def s26_tagged_records(spark, folder):
    rows = fx.tagged_records(spark, folder).withColumnRenamed("rec", "line")
    lines = tx.tagged(rows, "doc_id")
    first = lambda t: F.first(F.when(F.col("tag") == t, F.col("value")), ignorenulls=True)
    wide = lines.groupBy("doc_id").agg(F.max(F.when(F.col("tag") == "TP", F.concat(F.lit("TP   "), "value"))).alias("tp"), first("ID").alias("id"), first("RM").cast("bigint").alias("pmid"), F.count("*").alias("n_lines"))
    return wide


@query("select doc_id, array_to_string(list_transform(string_split(rec, '|'), lambda x: case when starts_with(x, 'TP') then concat(x, '|CL   CL', doc_id) else x end), '|') as rec from fx_desc")
def p23_insert_clan_line(spark, folder):
    return fx.tagged_records(spark, folder).select("doc_id", cu.set_tag("rec", "CL", F.concat(F.lit("CL"), "doc_id"), "TP").alias("rec"))


query.also("p23_insert_clan_line", "p23_insert_clan_line_all")


@query("select doc_id, array_to_string(list_transform(string_split(rec, '|'), lambda x: case when starts_with(x, 'DE') then 'DE   new text' else x end), '|') as rec from fx_desc")
def p23_replace_description(spark, folder):
    return fx.tagged_records(spark, folder).select("doc_id", cu.set_tag("rec", "DE", F.lit("new text"), "ID").alias("rec"))


_FLAT = """flat as (select doc_id, 10 * k as base, (k = 1 and source = 'git_log') or (k = 2 and author is null) as mapped,
  unnest([concat('RN   [', k, ']'), case when (k = 1 and source = 'git_log') or (k = 2 and author is null) then 'RP   NUCLEOTIDE SEQUENCE.' else 'RP   STRUCTURE.' end, 'RL   J. X. 1:2.']) as line,
  generate_subscripts([1, 2, 3], 1) as sub from documents, unnest([1, 2]) as u(k)),
rest as (select doc_id, source, author, 100 + i as place, line from (select doc_id, source, author, unnest([case when author is null then 'DR   PDB; 1abc;' else 'DR   STRING; 1.x;' end,
  concat('FT   ', case source when 'git_log' then 'HELIX' when 'mail_patch' then 'DOMAIN' else 'REGION' end, '   1..5'),
  case when source = 'web_hook' then 'FT                   /note="Disordered"' else 'FT                   /note="x"' end, 'SQ   SEQ']) as line, unnest([1, 2, 3, 4]) as i from documents))"""


def _flat(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "author")
    first = """array(concat('RN   [', k, ']'), case when (k = 1 and source = 'git_log') or (k = 2 and author is null) then 'RP   NUCLEOTIDE SEQUENCE.' else 'RP   STRUCTURE.' end, 'RL   J. X. 1:2.')"""
    second = """array(case when author is null then 'DR   PDB; 1abc;' else 'DR   STRING; 1.x;' end,
concat('FT   ', case source when 'git_log' then 'HELIX' when 'mail_patch' then 'DOMAIN' else 'REGION' end, '   1..5'),
case when source = 'web_hook' then 'FT                   /note="Disordered"' else 'FT                   /note="x"' end, 'SQ   SEQ')"""
    refs = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("doc_id", "k", F.posexplode(F.expr(first)).alias("i", "line"))
    rest = docs.select("doc_id", F.posexplode(F.expr(second)).alias("i", "line"))
    return refs.select("doc_id", (F.col("k") * 10 + F.col("i") + 1).alias("place"), "line").unionAll(rest.select("doc_id", (F.col("i") + 101).alias("place"), "line"))


@query(
    """select doc_id, cast(base + sub as integer) as place, line from flat where not mapped
union all select doc_id, place, line from rest where not (place = 101 and author is null) and not (place in (102, 103) and source in ('git_log', 'web_hook'))""",
    _FLAT,
)
def p22_filter_flat_file(spark, folder):
    return cu.filter_flat_file(_flat(spark, folder), "doc_id", "place", "line")


_SEQ = """seqs as (select p_partkey as acc, repeat(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), 9) as seq from part)"""


def _sequences(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("acc"), F.repeat(F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")), F.lit(9)).alias("seq"))


@query("select r.okey, r.ln, r.acc, r.fam, substr(s.seq, r.seq_start, least(r.seq_end, length(s.seq)) - r.seq_start + 1) as part from fx_family r join seqs s on s.acc = r.acc where r.seq_start <= length(s.seq)", _SEQ)
def p39_sequence_slices(spark, folder):
    rows = fx.family_regions(spark, folder).join(_sequences(spark, folder), "acc").where("seq_start <= length(seq)")
    return rows.select("okey", "ln", "acc", "fam", F.expr("substr(seq, cast(seq_start as int), cast(least(seq_end, length(seq)) - seq_start + 1 as int))").alias("part"))


@query(
    """select acc, count(*) filter (matches) as n_same, count(*) as n from (select r.acc, r.seq_end <= length(s.seq) and substr(s.seq, r.seq_start, r.seq_end - r.seq_start + 1)
= substr(repeat(substr(s.seq, 1, length(s.seq) // 9), 30), r.seq_start, r.seq_end - r.seq_start + 1) as matches from fx_family r join seqs s on s.acc = r.acc) group by acc""",
    _SEQ,
)
def p38_sequence_agreement(spark, folder):
    """Over whole regions; one that doesn't end within the sequence counts as different."""
    rows = fx.family_regions(spark, folder).join(_sequences(spark, folder), "acc")
    part = "substr({}, cast(seq_start as int), cast(seq_end - seq_start + 1 as int))"
    same = F.expr(f"seq_end <= length(seq) and {part.format('seq')} = {part.format('repeat(substr(seq, 1, cast(length(seq) div 9 as int)), 30)')}")
    return rows.groupBy("acc").agg(F.count_if(same).alias("n_same"), F.count("*").alias("n"))


query.also("p38_sequence_agreement", "p38_sequence_agreement_all")


@query("select acc, regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g') as wrapped from seqs", _SEQ)
def k12_wrapped_sequences(spark, folder):
    return _sequences(spark, folder).select("acc", F.regexp_replace("seq", "(.{60})", "$1\n").alias("wrapped"))


@query("select acc, length(seq) as n, md5(seq) as hash from seqs where length(seq) > 0", _SEQ)
def s19_fasta_records(spark, folder):
    lines = _sequences(spark, folder).select(F.concat(F.col("acc"), F.lit(" some text\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("line"))
    rows = tx.fasta(lines).where("sequence <> ''")
    return rows.select(F.col("id").cast("bigint").alias("acc"), F.length("sequence").cast("bigint").alias("n"), F.md5("sequence").alias("hash"))


@query("select s_suppkey as fam, format('ID   {}' || chr(10) || 'DE   Family {:03d}' || chr(10) || 'TP   Family', s_name, s_nationkey) as text from supplier")
def k13_template_records(spark, folder):
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("fam"), F.format_string("ID   %s\nDE   Family %03d\nTP   Family", "s_name", "s_nationkey").alias("text"))


@query("select c_nationkey as cluster, count(*) as n, min(c_custkey) as rep from customer group by c_nationkey having count(*) >= 55")
def a10_large_clusters(spark, folder):
    rows = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("cluster"))
    return rows.agg(F.count("*").alias("n"), F.min("c_custkey").alias("rep")).where("n >= 55")


@query("select c.c_custkey, coalesce(s.s_name, concat('Cluster_', c.c_custkey)) as name from customer c left join (select s_suppkey, s_name from supplier where s_acctbal > 0) s on s.s_suppkey = c.c_custkey")
def p40_cluster_names(spark, folder):
    named = table(spark, folder, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return table(spark, folder, "customer").join(named, "c_custkey", "left").select("c_custkey", F.coalesce("s_name", F.concat(F.lit("Cluster_"), "c_custkey")).alias("name"))


@query("select md5(coalesce(text, '')) as hash, count(*) as n, min(doc_id) as first_doc from documents group by 1")
def p41_content_hash(spark, folder):
    return table(spark, folder, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("select family, count(*) as n, count(*) filter (not regexp_matches(aln, '^[.-]|[.-]$')) as n_flush, round(avg(case when regexp_matches(aln, '^[.-]|[.-]$') then 0 else 1 end), 6) as share from fx_align group by family")
def p42_flush_rows(spark, folder):
    flush = ~F.col("aln").rlike("^[.-]|[.-]$")
    rows = fx.alignment(spark, folder).groupBy("family")
    return rows.agg(F.count("*").alias("n"), F.count_if(flush).alias("n_flush"), F.round(F.avg(flush.cast("double")), 6).alias("share"))


@query("select a.line_id, a.family from fx_align a where exists (select 1 from region_hits r where r.id = a.acc and r.significant = 1) and not exists (select 1 from ted_domains t where t.uniprot_acc = a.acc and t.consensus_level = 'high')")
def j28_marked_rows_without_template(spark, folder):
    marked = table(spark, folder, "region_hits").where("significant = 1").select(F.col("id").alias("acc"))
    template = table(spark, folder, "ted_domains").where("consensus_level = 'high'").select(F.col("uniprot_acc").alias("acc"))
    rows = fx.alignment(spark, folder).join(marked, "acc", "left_semi").join(template, "acc", "left_anti")
    return rows.select("line_id", "family")


@query("select d.domain_id, coalesce(a.family, b.family, d.ted_suffix) as name from ted_domains d left join (select id, min(family) as family from hits where family is not null group by id) a on a.id = d.uniprot_acc left join (select substr(id, 1, 4) as pre, min(family) as family from hits where family is not null and id is not null group by 1) b on b.pre = substr(d.uniprot_acc, 1, 4)",
       "hits as (select nullif(upper(trim(split_part(id, '.', 1))), '') as id, nullif(upper(trim(split_part(family, '.', 1))), '') as family from region_hits)")
def j29_name_with_fallbacks(spark, folder):
    hits = table(spark, folder, "region_hits").select(accession("id").alias("id"), accession("family").alias("family")).where("family is not null and id is not null")
    exact = hits.groupBy(F.col("id").alias("uniprot_acc")).agg(F.min("family").alias("exact"))
    near = hits.groupBy(F.substring("id", 1, 4).alias("pre")).agg(F.min("family").alias("near"))
    rows = table(spark, folder, "ted_domains").withColumn("pre", F.substring("uniprot_acc", 1, 4)).join(exact, "uniprot_acc", "left").join(near, "pre", "left")
    return rows.select("domain_id", F.coalesce("exact", "near", "ted_suffix").alias("name"))


@query("select c_custkey as id, 1 as part from customer where c_acctbal > 9000 union all select s_suppkey, 2 from supplier where s_acctbal > 5000 union all select p_partkey, 3 from part where p_size = 1")
def u01_concatenated_parts(spark, folder):
    parts = (("customer", "c_acctbal > 9000", "c_custkey"), ("supplier", "s_acctbal > 5000", "s_suppkey"), ("part", "p_size = 1", "p_partkey"))
    rows = [table(spark, folder, t).where(w).select(F.col(k).alias("id"), F.lit(n).alias("part")) for n, (t, w, k) in enumerate(parts, 1)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("select acc, aln, min(line_id) as line_id, count(*) as n from fx_align group by acc, aln")
def u02_first_of_equal_rows(spark, folder):
    return fx.alignment(spark, folder).groupBy("acc", "aln").agg(F.min("line_id").alias("line_id"), F.count("*").alias("n"))


@query("select distinct 1000000 + n_chars as pmid from documents where text is not null")
def u03_distinct_references(spark, folder):
    lines = tx.tagged(fx.tagged_records(spark, folder).withColumnRenamed("rec", "line"), "doc_id")
    return lines.where("tag = 'RM'").select(F.col("value").cast("bigint").alias("pmid")).distinct()


@query("select distinct repo from documents where received_at - committed_at > interval 5 day")
def u06_changed_groups(spark, folder):
    late = F.expr("received_at - committed_at > interval 5 days")
    return table(spark, folder, "documents").where(late).select("repo").distinct()


@query("select distinct n.region_id from region_hits n left join (select id, family, max(loaded_at) as known from region_hits where significant = 1 group by id, family) o on o.id = n.id and o.family = n.family where o.known is null or n.loaded_at > o.known")
def u07_newer_rows(spark, folder):
    """Rows loaded after the newest significant row of the same protein and family, or without one."""
    hits = table(spark, folder, "region_hits").withColumn("pair", F.when(F.col("id").isNotNull() & F.col("family").isNotNull(), F.struct("id", "family")))
    known = hits.where("significant = 1 and pair is not null").groupBy("pair").agg(F.max("loaded_at").alias("loaded_at"))
    return cu.newer_than(hits, known, "pair", "loaded_at").select("region_id").distinct()


@query("select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as k from customer) where k <= 5")
def w16_capped_per_group(spark, folder):
    by = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, folder, "customer").withColumn("k", F.row_number().over(by)).where("k <= 5").select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_name from customer order by md5(cast(c_custkey as varchar)), c_custkey limit 400")
def w18_down_sample(spark, folder):
    return cu.sample_by_hash(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey", 400)


@query(
    """select acc, pmid, source from (select *, row_number() over (partition by acc, pmid order by source) as k from (select l_suppkey as acc, l_partkey as pmid, 'a_snippet' as source from lineitem where l_quantity > 45
union all select l_suppkey, l_orderkey, 'b_curated' from lineitem where l_quantity < 3)) where k = 1"""
)
def j18_literature_union(spark, folder):
    rows = table(spark, folder, "lineitem")
    snippet = rows.where("l_quantity > 45").selectExpr("l_suppkey as acc", "l_partkey as pmid", "'a_snippet' as source")
    curated = rows.where("l_quantity < 3").selectExpr("l_suppkey as acc", "l_orderkey as pmid", "'b_curated' as source")
    return snippet.unionByName(curated).groupBy("acc", "pmid").agg(F.min("source").alias("source"))


@query("select l_suppkey as acc, l_partkey as pmid, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_brand = 'Brand#1' or p_size = 7) group by all")
def s28_prefiltered_bibliography(spark, folder):
    wanted = table(spark, folder, "part").where("p_brand = 'Brand#1' or p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, folder, "lineitem").join(wanted, "l_partkey", "left_semi")
    return rows.groupBy(F.col("l_suppkey").alias("acc"), F.col("l_partkey").alias("pmid")).agg(F.count("*").alias("n"))


@query("select s.s_suppkey, n.n_name, cast(count(p.l_orderkey) as bigint) as n_papers from supplier s join nation n on n.n_nationkey = s.s_nationkey left join (select * from lineitem where l_quantity > 40) p on p.l_suppkey = s.s_suppkey group by all")
def s29_batch_lookup(spark, folder):
    papers = table(spark, folder, "lineitem").where("l_quantity > 40").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    names = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, folder, "supplier").join(names, "s_nationkey").join(papers, "s_suppkey", "left")
    return rows.select("s_suppkey", "n_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_papers"))


@query("select c_custkey, c_name, c_nationkey, round(c_acctbal, 2) as c_acctbal from customer where c_acctbal >= 0")
def s27_comma_separated_scan(spark, folder):
    lines = table(spark, folder, "customer").select(F.expr("case when c_acctbal < 0 then '#' || c_custkey else concat_ws(',', c_custkey, c_name, c_nationkey, cast(c_acctbal as decimal(12,2))) end").alias("line"))
    rows = tx.by_delimiter(lines, {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double"}, ",", needed=("c_custkey",))
    return rows.select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("select family, acc, translate(string_agg(aln, '' order by line_id), '.', '-') as aln from fx_align group by family, acc")
def s18_joined_aligned_rows(spark, folder):
    ordered = F.sort_array(F.collect_list(F.struct("line_id", "aln")))
    rows = fx.alignment(spark, folder).groupBy("family", "acc")
    return rows.agg(F.translate(F.array_join(F.transform(ordered, lambda x: x["aln"]), ""), ".", "-").alias("aln"))


@query("select family, count(*) as n, count(distinct acc) as n_acc, max(length(regexp_replace(aln, '[^A-Za-z]', '', 'g'))) as longest from fx_align group by family")
def a42_sequence_counts(spark, folder):
    letters = F.length(F.regexp_replace("aln", "[^A-Za-z]", "")).cast("bigint")
    rows = fx.alignment(spark, folder).groupBy("family")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("acc").alias("n_acc"), F.max(letters).alias("longest"))


@query("select pfama_acc, pfama_id, model_length from pfama where model_length > 600")
def x45_long_families(spark, folder):
    return table(spark, folder, "pfama").where("model_length > 600").select("pfama_acc", "pfama_id", "model_length")


@query("select count(*) as n_hits, count(distinct q) as n_families, cast(1e-10 as double) as threshold from (select nullif(upper(trim(split_part(query_family, '.', 1))), '') as q from family_hits) where q is not null")
def k09_run_metadata(spark, folder):
    rows = table(spark, folder, "family_hits").select(accession("query_family").alias("q")).where("q is not null")
    return rows.agg(F.count("*").alias("n_hits"), F.countDistinct("q").alias("n_families")).withColumn("threshold", F.lit(1e-10))


@query("select o_custkey as root, o_orderkey as okey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) where k = 1")
def s20_first_member_of_cluster(spark, folder):
    return first_per_key(table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("okey"))


_EDITED = """edited as (select doc_id, concat(rec, '|SE   TED:P', doc_id, case when doc_id % 2 = 0 then '/Iterate' else '' end, '|ED   P', doc_id, '/1-9;', case when doc_id % 3 = 0 then '|**   DNI' when doc_id % 3 = 1 then '|**   other' else '' end) as rec from fx_desc)"""


def _edited(spark, folder):
    more = "concat(rec, '|SE   TED:P', doc_id, case when doc_id % 2 = 0 then '/Iterate' else '' end, '|ED   P', doc_id, '/1-9;', case when doc_id % 3 = 0 then '|**   DNI' when doc_id % 3 = 1 then '|**   other' else '' end)"
    return fx.tagged_records(spark, folder).select("doc_id", F.expr(more).alias("rec"))


@query("select doc_id, array_to_string(list_transform(string_split(rec, '|'), lambda x: case when starts_with(x, 'SE ') then concat('SE   AF:P', doc_id) else x end), '|') as rec from edited", _EDITED)
def p23_rewrite_seed_source(spark, folder):
    return _edited(spark, folder).select("doc_id", cu.rewrite_seed_source("rec", "AF").alias("rec"))


@query("select doc_id, array_to_string(list_filter(string_split(rec, '|'), lambda x: not starts_with(x, 'ED')), '|') as rec, doc_id % 3 = 0 as frozen from edited", _EDITED)
def p23_without_edits(spark, folder):
    return _edited(spark, folder).select("doc_id", cu.without_tag("rec", "ED").alias("rec"), cu.is_frozen("rec").alias("frozen"))


@query("select coalesce(family, '') as family, concat(acc, '.1/', first, '-', last) as full_id, string_agg(aln, '' order by line_id) as aln from fx_align group by coalesce(family, ''), acc, first, last")
def s16_wrapped_alignment(spark, folder):
    """Alignment files of a family, in lines of 20 columns: every second row goes on in lines that name it again, the others in
    bare lines; with comments and ends between them."""
    rows = fx.alignment(spark, folder).select(F.coalesce("family", F.lit("")).alias("family"), "line_id", F.concat("acc", F.lit(".1/"), "first", F.lit("-"), "last").alias("id"), "aln")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length("aln") - 1) / 20).cast("int")), lambda k: F.substr("aln", k * 20 + 1, F.lit(20)))
    lines = rows.select("family", "line_id", "id", F.posexplode(F.array_append(blocks, F.lit("# end"))).alias("block", "text"))
    line = F.when(F.col("text") == "# end", F.col("text")).when((F.col("block") == 0) | (F.col("line_id") % 2 == 0), F.concat_ws("   ", "id", "text")).otherwise(F.concat(F.lit("     "), "text"))
    lines = lines.select("family", F.struct("line_id", "block").alias("place"), line.alias("line"))
    return tx.alignment_blocks(lines, "family", "place").select("family", "full_id", "aln")
