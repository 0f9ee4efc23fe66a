"""Hit tables of searches between families, and networks made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldloom.functions import intervals as iv
from foldloom.functions.keys import accession
from foldloom.functions.scores import evalue_class, score_class, structure_probability, wilson_lower_bound
from foldloom.operators.intervals import overlap_join
from foldloom.operators.networks import best_edges, domain_frequencies, family_statistics, first_per_key, methods_side_by_side, neighbourhoods, pairs_within
from foldloom.plans.registry import Plans
from foldloom.sources import fixtures as fx
from foldloom.sources import lines as tx
from foldloom.sources.tables import table

query = Plans()
QUERIES, ORACLES = query.queries, query.oracles

_ACC = "nullif(upper(trim(split_part({0}, '.', 1), ' ' || chr(9) || chr(10) || chr(13))), '')"
_HITS = f"""fh as (select hit_id, {_ACC.format("query_family")} as q, {_ACC.format("target_family")} as t, qlo, qhi, tlo, thi, ql, tl, pctid, evalue, aq from family_hits),
full_hits as (select * from fh where q is not null and t is not null)"""


def _hits(spark, folder):
    return table(spark, folder, "family_hits").select(
        "hit_id", accession("query_family").alias("q"), accession("target_family").alias("t"), "qlo", "qhi", "tlo", "thi", "ql", "tl", "pctid", "evalue", "aq"
    )


def _full(spark, folder):
    return _hits(spark, folder).where("q is not null and t is not null")


ODD_LINES = ("", "   ", "# a note", "query\ttarget", "header of a report", "a\tb\tc\td")  # what stands between the rows of such files


def _with_odd(lines):
    """lines with odd ones behind each, which no reader may take for a row."""
    return lines.withColumn("line", F.explode(F.array("line", *map(F.lit, ODD_LINES))))


def _lines(spark, folder, line):
    return _with_odd(_full(spark, folder).select("hit_id", F.expr(line).alias("line")))


@query(
    """select hit_id, cast(hit_id % 500 as integer) as rank, t as target, cast(hit_id % 100 as double) as probability, cast(concat('1.5E-', hit_id % 200) as double) as evalue,
cast(concat('2E-', hit_id % 200) as double) as pvalue, cast(hit_id % 300 as double) as score, cast(hit_id % 9 - 4 as double) as ss, cast(qhi - qlo + 1 as integer) as cols, concat(qlo, '-', qhi) as query_range,
concat(tlo, '-', thi) as template_range, cast(tl as integer) as template_length from full_hits where qlo is not null and qhi is not null and tlo is not null and thi is not null and tl is not null and qhi >= qlo""",
    _HITS,
)
def s08_profile_hit_lines(spark, folder):
    line = "concat('  ', hit_id % 500, ' ', t, '   ', hit_id % 100, '.0 1.5E-', hit_id % 200, ' 2E-', hit_id % 200, '  ', hit_id % 300, '.0  ', hit_id % 9 - 4, '.0  ', qhi - qlo + 1, '  ', qlo, '-', qhi, '  ', tlo, '-', thi, ' (', tl, ')')"
    return tx.profile_hits(_lines(spark, folder, line)).drop("line")


@query("select hit_id, q as query, t as target, qlo, qhi, tlo, thi, ql, tl, cast(hit_id % 100 as double) as pctid, cast(concat('3e-', hit_id % 120) as double) as evalue, 0.5::double as aq from full_hits where evalue is not null and qlo is not null and qhi is not null and tlo is not null and thi is not null and ql is not null and tl is not null", _HITS)
def s09_structure_hit_lines(spark, folder):
    line = "concat_ws('\\t', case when evalue is null then concat('#', q) else q end, t, coalesce(cast(qlo as string), 'x'), coalesce(cast(qhi as string), 'x'), coalesce(cast(tlo as string), 'x'), coalesce(cast(thi as string), 'x'), coalesce(cast(ql as string), 'x'), coalesce(cast(tl as string), 'x'), hit_id % 100, concat('3e-', hit_id % 120), '0.5')"
    return tx.structure_hits(_lines(spark, folder, line)).drop("line")


@query(
    """select hit_id, q as query, t as target, 0.3::double as identity, qhi - qlo + 1 as alnlen, ql as qlen, tl as tlen, qlo as qstart, qhi as qend, tlo as tstart, thi as tend,
cast(concat('2e-', hit_id % 90) as double) as evalue, cast(hit_id % 700 as double) as bits from full_hits where qhi - qlo is not null and least(ql, tl, tlo, thi) is not null and ql is not null and tl is not null and tlo is not null and thi is not null""",
    _HITS,
)
def s10_alignment_hit_lines(spark, folder):
    line = "concat_ws('\\t', q, t, '0.3', qhi - qlo + 1, ql, tl, qlo, qhi, tlo, thi, concat('2e-', hit_id % 90), hit_id % 700)"
    rows = _full(spark, folder).where("qlo is not null and qhi is not null and ql is not null and tl is not null and tlo is not null and thi is not null")
    return tx.alignment_hits(_with_odd(rows.select("hit_id", F.expr(line).alias("line")))).drop("line")


@query("select q, t, count(*) as n, min(evalue) as best from full_hits f where evalue < 1e-3 and q <> t and (exists (select 1 from clan_membership c where c.pfama_acc = f.q and c.clan_acc is not null) or exists (select 1 from clan_membership c where c.pfama_acc = f.t and c.clan_acc is not null)) group by q, t", _HITS)
def s11_clan_hits(spark, folder):
    known = table(spark, folder, "clan_membership").where("clan_acc is not null").select("pfama_acc")
    rows = _full(spark, folder).where("evalue < 1e-3 and q <> t")
    flagged = rows.join(known.select(F.col("pfama_acc").alias("q"), F.lit(True).alias("q_in")), "q", "left").join(known.select(F.col("pfama_acc").alias("t"), F.lit(True).alias("t_in")), "t", "left")
    return flagged.where("q_in or t_in").groupBy("q", "t").agg(F.count("*").alias("n"), F.min("evalue").alias("best"))


@query("select hit_id, t as target, q as query, cast(concat('4e-', hit_id % 60) as double) as evalue, cast(hit_id % 250 as double) as score, row_number() over (partition by q order by cast(concat('4e-', hit_id % 60) as double), hit_id) as place from full_hits where evalue is not null", _HITS)
def s12_search_table(spark, folder):
    line = "case when evalue is null then concat('# ', t) else concat(t, '   ', q, '  ', '4e-', hit_id % 60, '   ', hit_id % 250, '.0') end"
    rows = tx.table_hits(_lines(spark, folder, line)).drop("line")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("evalue", "hit_id")).cast("bigint"))


@query(
    """select hit_id, round(case when evalue < 1e-100 then 100.0::double when evalue < 1e-10 then 99.9::double when evalue < 0.01 then 99.0 + (1 - evalue * 100) when evalue < 1 then 90.0 + (1 - evalue) * 9 else 100.0 / (1.0 + evalue) end, 6) as probability,
case when evalue < 1e-10 then 'strong' when evalue < 1e-5 then 'medium' else 'weak' end as class, case when evalue < 1e-5 then 'strong' when evalue < 1e-3 then 'medium' else 'weak' end as structure_class,
case when pctid * aq > 30 then 'strong' when pctid * aq >= 10 then 'medium' else 'weak' end as score_class from fh where evalue is not null and pctid is not null and aq is not null""",
    _HITS,
)
def p12_hit_classes(spark, folder):
    """P12 to P15."""
    e = F.col("evalue")
    rows = _hits(spark, folder).where("evalue is not null and pctid is not null and aq is not null")
    return rows.select(
        "hit_id",
        F.round(structure_probability(e), 6).alias("probability"),
        evalue_class(e).alias("class"),
        evalue_class(e, 1e-5, 1e-3).alias("structure_class"),
        score_class(F.col("pctid") * F.col("aq"), 30, 10).alias("score_class"),
    )


@query(
    """select hit_id, cast(regexp_extract(concat('  ', qlo, '-', qhi, ' (', ql, ')'), '([0-9]+)-([0-9]+)', 1) as bigint) as first, cast(regexp_extract(concat('  ', qlo, '-', qhi), '([0-9]+)-([0-9]+)', 2) as bigint) as last
from fh where qlo is not null and qhi is not null""",
    _HITS,
)
def p11_range_strings(spark, folder):
    lines = _hits(spark, folder).where("qlo is not null and qhi is not null").select("hit_id", F.expr("concat('  ', qlo, '-', qhi, ' (', coalesce(ql, 0), ')')").alias("line"))
    return tx.by_pattern(lines, r"(\d+)-(\d+)", {"first": "bigint", "last": "bigint"}).drop("line")


@query(
    """select hit_id, q, t, round(o, 6) as overlap from (select *, case when (case when coalesce(ql, 0) > 0 and coalesce(tl, 0) > 0 then least(ql, tl) else qhi - qlo + 1 end) > 0
then (qhi - qlo + 1) / (case when coalesce(ql, 0) > 0 and coalesce(tl, 0) > 0 then least(ql, tl) else qhi - qlo + 1 end) else 0 end as o from full_hits where qlo is not null and qhi is not null) where o >= 0.5 and evalue <= 1e-3""",
    _HITS,
)
def p21_overlap_of_shorter(spark, folder):
    aligned = F.col("qhi") - F.col("qlo") + 1
    shorter = F.when((F.coalesce("ql", F.lit(0)) > 0) & (F.coalesce("tl", F.lit(0)) > 0), F.least("ql", "tl")).otherwise(aligned)
    overlap = F.when(shorter > 0, aligned / shorter).otherwise(0.0)
    rows = _full(spark, folder).where("qlo is not null and qhi is not null").withColumn("o", overlap)
    return rows.where("o >= 0.5 and evalue <= 1e-3").select("hit_id", "q", "t", F.round("o", 6).alias("overlap"))


@query(
    """select f.q, s.n_hits, f.evalue as best_evalue, f.t as best_target, f.aq as best_score, s.n_strong from (select *, row_number() over (partition by q order by evalue, hit_id) as k from full_hits where evalue is not null) f
join (select q, count(*) as n_hits, count(*) filter (evalue < 1e-10) as n_strong from full_hits where evalue is not null group by q) s on s.q = f.q where f.k = 1""",
    _HITS,
)
def a06_family_statistics(spark, folder):
    return family_statistics(_full(spark, folder), "q", "t", "evalue", "aq", "hit_id")


@query("select count(*) as n, count(p.pfama_acc) as n_mapped, count(*) - count(p.pfama_acc) as n_unmapped from full_hits f left join pfama p on p.pfama_acc = f.t", _HITS)
def a07_mapped_counts(spark, folder):
    known = table(spark, folder, "pfama").select(F.col("pfama_acc").alias("t"), F.lit(1).alias("known"))
    rows = _full(spark, folder).join(known, "t", "left")
    return rows.agg(F.count("*").alias("n"), F.count("known").alias("n_mapped"), F.count_if(F.col("known").isNull()).alias("n_unmapped"))


@query("select least(q, t) as fam_1, greatest(q, t) as fam_2, min(evalue) as evalue, count(*) as n_rows from full_hits where q <> t and evalue < 1e-3 group by 1, 2", _HITS)
def w20_best_edges(spark, folder):
    return best_edges(_full(spark, folder).where("evalue < 1e-3"), "q", "t", "evalue")


_EDGES = f"""{_HITS},
by_e as (select least(q, t) as fam_1, greatest(q, t) as fam_2, min(evalue) as v from full_hits where q <> t and evalue < 1e-3 group by 1, 2),
by_aq as (select least(q, t) as fam_1, greatest(q, t) as fam_2, max(aq) as v from full_hits where q <> t and aq >= 0.6 group by 1, 2),
side as (select coalesce(a.fam_1, b.fam_1) as fam_1, coalesce(a.fam_2, b.fam_2) as fam_2, a.v as profile, b.v as structure from by_e a full join by_aq b on a.fam_1 = b.fam_1 and a.fam_2 = b.fam_2)"""


def _combined(spark, folder):
    full = _full(spark, folder)
    edges = {
        "profile": best_edges(full.where("evalue < 1e-3"), "q", "t", "evalue").withColumnRenamed("evalue", "v"),
        "structure": best_edges(full.where("aq >= 0.6"), "q", "t", "aq", lowest=False).withColumnRenamed("aq", "v"),
    }
    return methods_side_by_side(edges, ["fam_1", "fam_2"], "v")


@query("select fam_1, fam_2, profile, structure, cast(case when profile is null then 0 else 1 end + case when structure is null then 0 else 1 end as integer) as n_methods from side", _EDGES)
def j24_methods_side_by_side(spark, folder):
    return _combined(spark, folder)


@query(
    """select n.fam, coalesce(p.pfama_id, n.fam) as name, coalesce(p.family_type, 'Domain') as family_type, coalesce(p.model_length, 100) as model_length, coalesce(c.clan_acc, 'No_clan') as clan, count(*) as degree
from (select fam_1 as fam from side union all select fam_2 from side) n left join pfama p on p.pfama_acc = n.fam left join clan_membership c on c.pfama_acc = n.fam group by all""",
    _EDGES,
)
def j25_node_attributes(spark, folder):
    nodes = _combined(spark, folder).select(F.explode(F.array("fam_1", "fam_2")).alias("fam")).groupBy("fam").agg(F.count("*").alias("degree"))
    info = table(spark, folder, "pfama").withColumnRenamed("pfama_acc", "fam")
    clans = table(spark, folder, "clan_membership").select(F.col("pfama_acc").alias("fam"), "clan_acc")
    rows = nodes.join(info, "fam", "left").join(clans, "fam", "left")
    return rows.select(
        "fam",
        F.coalesce("pfama_id", "fam").alias("name"),
        F.coalesce("family_type", F.lit("Domain")).alias("family_type"),
        F.coalesce("model_length", F.lit(100).cast("bigint")).alias("model_length"),
        F.coalesce("clan_acc", F.lit("No_clan")).alias("clan"),
        "degree",
    )


@query(
    """select f.hit_id, f.q, coalesce(e.pfama_id, b.pfama_id, 'UNKNOWN') as target_name from fh f left join (select target_family as raw, max(p.pfama_id) as pfama_id from (select distinct target_family from family_hits) h join pfama p on p.pfama_acc = h.target_family group by 1) e
on e.raw = (select r.target_family from family_hits r where r.hit_id = f.hit_id) left join pfama b on b.pfama_acc = f.t""",
    _HITS,
)
def j13_name_by_exact_or_bare_id(spark, folder):
    raw = table(spark, folder, "family_hits").select("hit_id", accession("query_family").alias("q"), "target_family", accession("target_family").alias("bare"))
    names = table(spark, folder, "pfama").select("pfama_acc", "pfama_id")
    exact = names.select(F.col("pfama_acc").alias("target_family"), F.col("pfama_id").alias("exact"))
    base = names.select(F.col("pfama_acc").alias("bare"), F.col("pfama_id").alias("by_base"))
    rows = raw.join(exact, "target_family", "left").join(base, "bare", "left")
    return rows.select("hit_id", "q", F.coalesce("exact", "by_base", F.lit("UNKNOWN")).alias("target_name"))


_NESTED = """nested as (select distinct a.fam as outer_fam, b.fam as inner_fam from fx_family a join fx_family b on a.acc = b.acc and a.seq_start < b.seq_start and b.seq_end < a.seq_end and a.fam <> b.fam),
cand as (select distinct a.fam as a, b.fam as b from fx_family a join fx_family b on a.acc = b.acc and a.fam < b.fam)"""


def _nested(spark, folder):
    regions = fx.family_regions(spark, folder).select("acc", "fam", "seq_start", "seq_end").distinct()
    a = regions.selectExpr("acc", "fam as outer_fam", "seq_start as os", "seq_end as oe")
    b = regions.selectExpr("acc", "fam as inner_fam", "seq_start as i_s", "seq_end as i_e")
    inside = overlap_join(a, b, "acc", "os", "oe", "i_s", "i_e").where("os < i_s and i_e < oe and outer_fam <> inner_fam")
    return inside.select("outer_fam", "inner_fam").distinct()


@query("select outer_fam, inner_fam from nested where outer_fam in (select fam from fx_clan where clan_acc is not null) or inner_fam in (select fam from fx_clan where clan_acc is not null)", _NESTED)
def j16_nested_in_clan(spark, folder):
    members = fx.clans(spark, folder).where("clan_acc is not null").select("fam")
    nested = _nested(spark, folder)
    outer = nested.join(members, nested["outer_fam"] == members["fam"], "left_semi")
    inner = nested.join(members, nested["inner_fam"] == members["fam"], "left_semi")
    return outer.union(inner).distinct()


@query(
    """select c.a, c.b, case when ka.clan_acc is not null and ka.clan_acc = kb.clan_acc then 'TRUE'
when exists (select 1 from nested n where (n.outer_fam = c.a and n.inner_fam = c.b) or (n.outer_fam = c.b and n.inner_fam = c.a)) then 'NESTED'
when ka.clan_acc is null and kb.clan_acc is null then 'LINKED_2' when ka.clan_acc is null or kb.clan_acc is null then 'LINKED_1' else 'FALSE' end as label
from cand c left join fx_clan ka on ka.fam = c.a left join fx_clan kb on kb.fam = c.b""",
    _NESTED,
)
def j17_pair_truth(spark, folder):
    pairs = pairs_within(fx.family_regions(spark, folder), "acc", "fam")
    clans = fx.clans(spark, folder)
    nested = _nested(spark, folder).select(F.least("outer_fam", "inner_fam").alias("a"), F.greatest("outer_fam", "inner_fam").alias("b"), F.lit(True).alias("nests")).distinct()
    rows = pairs.join(clans.select(F.col("fam").alias("a"), F.col("clan_acc").alias("ka")), "a", "left").join(clans.select(F.col("fam").alias("b"), F.col("clan_acc").alias("kb")), "b", "left")
    label = (
        F.when(F.col("ka") == F.col("kb"), "TRUE")
        .when(F.col("nests"), "NESTED")
        .when(F.col("ka").isNull() & F.col("kb").isNull(), "LINKED_2")
        .when(F.col("ka").isNull() | F.col("kb").isNull(), "LINKED_1")
        .otherwise("FALSE")
    )
    return rows.join(nested, ["a", "b"], "left").select("a", "b", label.alias("label"))


@query("select hit_id, q, row_number() over (partition by q order by evalue, hit_id) as place from full_hits where evalue is not null", _HITS)
def w17_rank_by_evalue(spark, folder):
    by = Window.partitionBy("q").orderBy("evalue", "hit_id")
    return _full(spark, folder).where("evalue is not null").select("hit_id", "q", F.row_number().over(by).cast("bigint").alias("place"))


@query("select f from (select q as f from full_hits union select t from full_hits) except select pfama_acc from pfama", _HITS)
def u04_families_without_entry(spark, folder):
    full = _full(spark, folder)
    return full.select(F.explode(F.array("q", "t")).alias("f")).distinct().join(table(spark, folder, "pfama").select(F.col("pfama_acc").alias("f")), "f", "left_anti")


@query("select taxid, p1, p2, score from fx_links where score >= 400")
def s13_scored_links(spark, folder):
    lines = fx.links(spark, folder).select("taxid", F.concat_ws(" ", "p1", "p2", "score").alias("line"))
    rows = tx.scored_links(_with_odd(lines)).where("score >= 400")
    return rows.select("taxid", F.col("protein1").cast("bigint").alias("p1"), F.col("protein2").cast("bigint").alias("p2"), "score")


@query("select concat('9606.', s_suppkey) as string_id, array_to_string(list(s_name order by s_name), ',') as names from supplier where s_acctbal >= 0 group by s_suppkey")
def s14_aliases(spark, folder):
    lines = table(spark, folder, "supplier").select(F.expr("concat_ws('\\t', concat('9606.', s_suppkey), s_name, case when s_acctbal < 0 then 'Other' else 'UniProt_AC' end)").alias("line"))
    return tx.aliases(lines).groupBy("string_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), ",").alias("names"))


@query("select s_suppkey, cast(9000 + s_nationkey as bigint) as taxid, concat('P', s_suppkey) as protein from supplier where s_acctbal >= 0")
def s15_cross_references(spark, folder):
    lines = table(spark, folder, "supplier").select("s_suppkey", F.expr("concat('DR   ', case when s_acctbal < 0 then 'PDB; ' else 'STRING; ' end, 9000 + s_nationkey, '.P', s_suppkey, '; -.')").alias("line"))
    return tx.cross_reference(_with_odd(lines)).select("s_suppkey", "taxid", "protein")


_NET = """net as (select l.taxid, l.p1, l.p2, r.fam from (select distinct taxid, p1, p2 from fx_links where score >= 400) l join (select distinct acc, fam from fx_family) r on r.acc = l.p2)"""


def _network(spark, folder):
    links = fx.links(spark, folder).where("score >= 400").select("taxid", "p1", "p2").distinct()
    regions = fx.family_regions(spark, folder).select(F.col("acc").alias("p2"), "fam").distinct()
    return links.join(regions, "p2")


@query("select n.taxid, n.p1, k.fam_id, count(*) as n_partners from net n join fx_clan k on k.fam = n.fam group by all", _NET)
def j14_partner_domains(spark, folder):
    names = fx.clans(spark, folder).select("fam", "fam_id")
    counts = _network(spark, folder).groupBy("taxid", "p1", "fam").agg(F.count("*").alias("n_partners"))
    return counts.join(names, "fam").select("taxid", "p1", "fam_id", "n_partners")


@query("select f.t as family, coalesce(p.pfama_id, f.t) as name, count(*) as n from full_hits f left join pfama p on p.pfama_acc = f.t where f.q in (select pfama_acc from clan_membership) group by all", _HITS)
def j15_lookup_with_fallback(spark, folder):
    known = table(spark, folder, "clan_membership").select(F.col("pfama_acc").alias("q"))
    names = table(spark, folder, "pfama").select(F.col("pfama_acc").alias("t"), "pfama_id")
    counts = _full(spark, folder).join(known, "q", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    return counts.join(names, "t", "left").select(F.col("t").alias("family"), F.coalesce("pfama_id", "t").alias("name"), "n")


@query(
    """select fam, k as n_networks, round(k / t, 6) as frequency, round(greatest(0, (k / t + 1.96 * 1.96 / (2 * t) - 1.96 * sqrt((k / t * (1 - k / t) + 1.96 * 1.96 / (4 * t)) / t)) / (1 + 1.96 * 1.96 / t)), 6) as bound
from (select fam, cast(count(distinct p1) as double) as kd, count(distinct p1) as k from net group by fam) c, (select cast(count(distinct p1) as double) as t from net) a where k / t >= 0.3 and k >= 5""",
    _NET,
)
def a08_domain_frequencies(spark, folder):
    return domain_frequencies(_network(spark, folder), "p1", "fam")


@query("select k, n, round(greatest(0, (k / n + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt((k / n * (1 - k / n) + 1.645 * 1.645 / (4 * n)) / n)) / (1 + 1.645 * 1.645 / n)), 6) as bound from (select distinct cast(l_linenumber as double) as k, cast(l_linenumber + floor(l_quantity) as double) as n from lineitem)")
def p16_wilson_bound(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("cast(l_linenumber as double) as k", "cast(l_linenumber + floor(l_quantity) as double) as n").distinct()
    return rows.select("k", "n", F.round(wilson_lower_bound(F.col("k"), F.col("n"), 0.90), 6).alias("bound"))


@query(f"""select fam, {", ".join(f"array_to_string(list_sort(list(distinct p1) filter (taxid = {k})), ',') as net_{k}" for k in range(1, 8))} from net group by fam""", _NET)
def a43_family_by_network(spark, folder):
    species = range(1, 8)
    wide = _network(spark, folder).groupBy("fam").pivot("taxid", list(species)).agg(F.array_join(F.sort_array(F.collect_set("p1")), ","))
    return wide.select("fam", *[F.when(F.col(str(k)) != "", F.col(str(k))).alias(f"net_{k}") for k in species])


@query(
    """select start, node, cast(min(hop) as integer) as hop from walk group by start, node""",
    """both_ways as (select distinct p1 as a, p2 + 1000000 as b from fx_links where score >= 400 union select distinct p2 + 1000000, p1 from fx_links where score >= 400),
walk as (select p1 as start, p1 as node, 0 as hop from fx_links where p1 % 50 = 0 union select p2 + 1000000, p2 + 1000000, 0 from fx_links where p2 % 50 = 0
union select w.start, b.b, w.hop + 1 from walk w join both_ways b on b.a = w.node where w.hop < 2)""",
)
def x02_neighbourhood(spark, folder):
    """Of the query proteins, those with an id divisible by 50, over all links."""
    links = fx.links(spark, folder).selectExpr("p1", "p2 + 1000000 as p2", "score")
    starts = links.select(F.explode(F.array("p1", "p2")).alias("id")).where("id % 50 = 0").distinct()
    return neighbourhoods(links.where("score >= 400"), "p1", "p2", starts, "id", 2)


@query(
    """select start, node, cast(min(hop) as integer) as hop from walk group by start, node""",
    """both_ways as (select distinct p1 as a, p2 + 1000000 as b from fx_links where score >= 400 union select distinct p2 + 1000000, p1 from fx_links where score >= 400),
walk as (select p1 as start, p1 as node, 0 as hop from fx_links union select p2 + 1000000, p2 + 1000000, 0 from fx_links
union select w.start, b.b, w.hop + 1 from walk w join both_ways b on b.a = w.node where w.hop < 2)""",
)
def x02_neighbourhood_all(spark, folder):
    """Of every protein that has a link, whatever its score."""
    links = fx.links(spark, folder).selectExpr("p1", "p2 + 1000000 as p2", "score")
    starts = links.select(F.explode(F.array("p1", "p2")).alias("id")).distinct()
    return neighbourhoods(links.where("score >= 400"), "p1", "p2", starts, "id", 2)


_BEST = """spans as (select okey, ln, acc, min(cast(split_part(x, '-', 1) as bigint)) as s, max(cast(split_part(x, '-', 2) as bigint)) as e from (select *, unnest(string_split(chopping, '_')) as x from fx_ted) group by okey, ln, acc, fam, chopping),
cons as (select p.acc, p.okey, p.ln, p.fam, p.seq_start, p.seq_end, coalesce(max(case when greatest(t.s, p.seq_start) <= least(t.e, p.seq_end) then least((least(t.e, p.seq_end) - greatest(t.s, p.seq_start) + 1) / (p.seq_end - p.seq_start + 1),
  (least(t.e, p.seq_end) - greatest(t.s, p.seq_start) + 1) / (t.e - t.s + 1)) else 0 end), 0) as score from fx_family p left join spans t on t.acc = p.acc group by all)"""


def _consistency(spark, folder):
    """The best match of each region; different intervals of a protein are compared once, whatever number of rows has them."""
    spans = iv.with_spans(fx.structure_domains(spark, folder), "chopping").selectExpr("acc", "span_s as s", "span_e as e").distinct()
    regions = fx.family_regions(spark, folder).select("acc", "okey", "ln", "fam", "seq_start", "seq_end").distinct()
    common = iv.overlap("s", "e", "seq_start", "seq_end")
    score = F.least(common / (F.col("seq_end") - F.col("seq_start") + 1), common / (F.col("e") - F.col("s") + 1))
    ends = ["acc", "seq_start", "seq_end"]
    best = overlap_join(regions.select(*ends).distinct(), spans, "acc", "seq_start", "seq_end", "s", "e").groupBy(*ends).agg(F.max(score).alias("score"))
    return regions.join(best, ends, "left").select("acc", "okey", "ln", "fam", "seq_start", "seq_end", F.coalesce("score", F.lit(0.0)).alias("score"))


@query("select acc, okey, ln, fam, seq_start, seq_end, round(score, 6) as score from cons", _BEST)
def p26_consistency(spark, folder):
    return _consistency(spark, folder).withColumn("score", F.round("score", 6))


@query("select fam, round(avg(score), 6) as mean_score, count(*) as n from cons group by fam", _BEST)
def a16_mean_consistency(spark, folder):
    return _consistency(spark, folder).groupBy("fam").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))


@query("select q, t, hit_id from (select *, row_number() over (partition by q order by hit_id) as k from full_hits) where k = 1", _HITS)
def s32_first_file_wins(spark, folder):
    return first_per_key(_full(spark, folder).select("q", "t", "hit_id"), ["q"], ["hit_id"])


@query("select taxid, p1, p2, score from fx_links where score >= 400")
def s13_links_by_header(spark, folder):
    """Columns by their names in the first line of each species' file."""
    links = fx.links(spark, folder)
    heads = links.select("taxid").distinct().withColumn("line", F.lit("neighborhood protein2 combined_score fusion protein1"))
    lines = links.select("taxid", F.concat_ws(" ", F.lit("0"), "p2", "score", F.lit("0"), "p1").alias("line")).unionByName(heads)
    rows = tx.by_header(lines, "taxid", {"protein1": "bigint", "protein2": "bigint", "combined_score": "bigint"}, needed=("combined_score",)).where("combined_score >= 400")
    return rows.select("taxid", F.col("protein1").alias("p1"), F.col("protein2").alias("p2"), F.col("combined_score").alias("score"))


@query(
    """select fam, concat(fam, chr(9), name, chr(9), k, chr(9), format('{:.2f}', frequency), chr(9), format('{:.2f}', bound)) as line from (select fam, coalesce(max(fam_id), cast(fam as varchar)) as name, k, round(k / t, 6) as frequency,
round(greatest(0, (k / t + 1.96 * 1.96 / (2 * t) - 1.96 * sqrt((k / t * (1 - k / t) + 1.96 * 1.96 / (4 * t)) / t)) / (1 + 1.96 * 1.96 / t)), 6) as bound from (select c.fam, c.k, a.t, n.fam_id from (select fam, count(distinct p1) as k from net group by fam) c cross join (select cast(count(distinct p1) as double) as t from net) a left join fx_clan n on n.fam = c.fam) group by fam, k, t)
where frequency >= 0.3 and k >= 5""",
    _NET,
)
def k06_network_report(spark, folder):
    """The lines of the compact report: domain, name, networks, frequency, lower bound."""
    names = fx.clans(spark, folder).groupBy("fam").agg(F.max("fam_id").alias("fam_id"))
    rows = domain_frequencies(_network(spark, folder), "p1", "fam").join(names, "fam", "left")
    name = F.coalesce("fam_id", F.col("fam").cast("string"))
    return rows.select("fam", F.concat_ws("\t", "fam", name, "n_networks", F.format_string("%.2f", "frequency"), F.format_string("%.2f", "bound")).alias("line"))
