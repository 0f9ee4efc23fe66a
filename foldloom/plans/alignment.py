"""Alignment columns, trimming, coordinates and consensus domains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldloom.functions import intervals as iv
from foldloom.operators import alignment as al
from foldloom.operators import consensus as co
from foldloom.operators.intervals import overlap_join
from foldloom.operators.islands import merged, runs
from foldloom.plans.registry import Plans, greedy
from foldloom.sources import fixtures as fx
from foldloom.sources.tables import table

query = Plans()
QUERIES, ORACLES = query.queries, query.oracles

_OCC = """size as (select family, count(*) as n, max(length(aln)) as width from fx_align group by family),
cell as (select family, k as col, count(*) filter (substr(aln, k, 1) not in ('.', '-', '')) as filled from fx_align, unnest(range(1, length(aln) + 1)) as u(k) group by all),
occ as (select c.family, c.col - 1 as col, c.filled / s.n as occ from cell c join size s using (family))"""


def _occ(spark, folder):
    return al.occupancy(fx.alignment(spark, folder), "family", "aln")


@query("select family, col, round(occ, 6) as occ from occ", _OCC)
def a17_column_occupancy(spark, folder):
    return _occ(spark, folder).withColumn("occ", F.round("occ", 6))


@query("select family, col, round(avg(occ) over (partition by family order by col rows between 2 preceding and 2 following), 6) as smooth from occ", _OCC)
def w01_moving_average(spark, folder):
    return al.smoothed(_occ(spark, folder), "family", 5).select("family", "col", F.round("smooth", 6).alias("smooth"))


_TRIM = f"{_OCC}, trim as (select family, coalesce(min(col) filter (occ >= 0.6), 0) as trim_start, coalesce(max(col) filter (occ >= 0.6), max(col)) as trim_end from occ group by family)"


@query("select * from trim", _TRIM)
def w02_trim_by_threshold(spark, folder):
    return al.trim_by_threshold(_occ(spark, folder), "family", 0.6)


@query(
    """select l.family, coalesce(a.at, 0) as trim_start, coalesce(b.at, l.last) as trim_end from (select family, max(col) as last from occ group by family) l
left join (select family, col + 1 as at, row_number() over (partition by family order by round(up, 9) desc, col) as k from g where col < greatest(coalesce(first_full, 0), 1) and next_occ >= 0.1) a on a.family = l.family and a.k = 1
left join (select family, col as at, row_number() over (partition by family order by round(-up, 9) desc, col) as k from g where col >= least(coalesce(last_full, last), last - 1) and occ >= 0.1) b on b.family = l.family and b.k = 1""",
    f"""{_OCC}, g0 as (select *, lead(occ) over (partition by family order by col) as next_occ, min(case when occ >= 0.9 then col end) over (partition by family) as first_full,
max(case when occ >= 0.9 then col end) over (partition by family) as last_full, max(col) over (partition by family) as last from occ), g as (select *, next_occ - occ as up from g0 where next_occ is not null)""",
)
def w03_trim_by_gradient(spark, folder):
    return al.trim_by_gradient(_occ(spark, folder), "family")


@query(
    """select line_id, col, first - 1 + row_number() over (partition by line_id order by col) as residue from (select line_id, first, k as col from fx_align, unnest(range(1, length(aln) + 1)) as u(k) where substr(aln, k, 1) not in ('.', '-'))"""
)
def w04_coordinate_map(spark, folder):
    rows = fx.alignment(spark, folder).select("line_id", "first", F.posexplode(al.residue_columns("aln")).alias("k", "col"))
    return rows.select("line_id", F.col("col").cast("bigint").alias("col"), (F.col("first") + F.col("k")).alias("residue"))


@query(
    """select line_id, part, case when kept > 0 then first + length(regexp_replace(substr(aln, 1, trim_start), '[.-]', '', 'g')) else first end as new_first,
case when kept > 0 then first + length(regexp_replace(substr(aln, 1, trim_start), '[.-]', '', 'g')) + kept - 1 else first - 1 end as new_last
from (select a.*, t.trim_start, substr(a.aln, t.trim_start + 1, t.trim_end - t.trim_start + 1) as part, length(regexp_replace(substr(a.aln, t.trim_start + 1, t.trim_end - t.trim_start + 1), '[.-]', '', 'g')) as kept
from fx_align a join trim t on t.family = a.family)""",
    _TRIM,
)
def x39_trimmed_rows(spark, folder):
    trims = al.trim_by_threshold(_occ(spark, folder), "family", 0.6)
    rows = fx.alignment(spark, folder).join(trims, "family")
    out = al.sliced(rows, "aln", "first", F.col("trim_start"), F.col("trim_end"))
    return out.select("line_id", "part", "new_first", "new_last")


_SPANS = """tspan as (select domain_id, uniprot_acc as acc, min(cast(split_part(x, '-', 1) as bigint)) as s, max(cast(split_part(x, '-', 2) as bigint)) as e
  from (select *, unnest(string_split(chopping, '_')) as x from ted_domains where chopping is not null) where regexp_full_match(x, '[0-9]+-[0-9]+') and length(x) < 18 group by domain_id, uniprot_acc),
amap as (select line_id, first - 1 + row_number() over (partition by line_id order by k) as residue, k as col from (select line_id, first, k from fx_align, unnest(range(1, length(aln) + 1)) as u(k) where substr(aln, k, 1) not in ('.', '-'))),
met as (select a.line_id, t.domain_id, greatest(t.s, a.first) as cs, least(t.e, a.last) as ce from fx_align a join tspan t on t.acc = a.acc and t.e >= a.first and t.s <= a.last)"""


def _spans(spark, folder):
    return iv.with_spans(table(spark, folder, "ted_domains"), "chopping").selectExpr("domain_id", "uniprot_acc as acc", "span_s as s", "span_e as e")


@query("select m.line_id, m.domain_id, p.col as col_s, q.col as col_e from met m join amap p on p.line_id = m.line_id and p.residue = m.cs join amap q on q.line_id = m.line_id and q.residue = m.ce", _SPANS)
def x36_domains_in_alignment(spark, folder):
    rows = overlap_join(fx.alignment(spark, folder), _spans(spark, folder), "acc", "first", "last", "s", "e")
    out = al.span_to_columns(rows, "aln", "first", "last", "s", "e")
    return out.select("line_id", "domain_id", F.col("col_s").cast("bigint").alias("col_s"), F.col("col_e").cast("bigint").alias("col_e"))


_CL = """jump as (select *, case when s - lag(s) over (partition by prot order by s, event_id) <= 3 then 0 else 1 end as j from fx_pred),
cl as (select * exclude (j), cast(sum(j) over (partition by prot order by s, event_id) as bigint) as cluster from jump),
agg as (select prot, cluster, cast(floor(median(s)) as bigint) as cons_s, cast(floor(median(e)) as bigint) as cons_e, count(*) as n, count(distinct day) as n_sequences, count(distinct method) as n_methods from cl group by prot, cluster),
tot as (select prot, count(distinct day) as total from fx_pred group by prot)"""


def _clusters(spark, folder):
    return co.clusters_by_start(fx.predictions(spark, folder), ["prot"], "s", ["event_id"], 3)


def _consensus(spark, folder):
    return co.consensus(_clusters(spark, folder), ["prot"], "s", "e", "day", "method")


@query("select * from agg", _CL)
def a20_cluster_consensus(spark, folder):
    return _consensus(spark, folder)


@query("select prot, cluster, method, count(*) as n from cl group by all", _CL)
def a18_method_agreement(spark, folder):
    return _clusters(spark, folder).groupBy("prot", "cluster", "method").agg(F.count("*").alias("n"))


@query("select a.prot, a.cluster, round(a.n_sequences / t.total, 6) as coverage from agg a join tot t using (prot)", _CL)
def a19_sequence_coverage(spark, folder):
    total = fx.predictions(spark, folder).groupBy("prot").agg(F.countDistinct("day").alias("total"))
    rows = _consensus(spark, folder).join(total, "prot")
    return rows.select("prot", "cluster", F.round(F.col("n_sequences") / F.col("total"), 6).alias("coverage"))


@query(
    """select prot, cluster, round(n_sequences / total, 6) as majority, round(n_methods / 3.0::double, 6) as method_agreement, round(0.5 * (n_methods / 3.0::double) + 0.5 * (n_sequences / total), 6) as combined,
round(case when n_methods < 2 then 0 else n_sequences / total end, 6) as any_two_methods, round(case when n_methods < 3 then 0 else n_sequences / total end, 6) as all_three_methods, round(n / total / 3.0::double, 6) as weighted_method
from agg join tot using (prot)""",
    _CL,
)
def x34_strategies(spark, folder):
    total = fx.predictions(spark, folder).groupBy("prot").agg(F.countDistinct("day").alias("total"))
    return co.scored(_consensus(spark, folder).join(total, "prot"), "total").select("prot", "cluster", *co.STRATEGIES)


@query(
    """select prot, method, cluster, cast(floor(median(s)) as bigint) as cons_s, cast(floor(median(e)) as bigint) as cons_e, round(count(distinct day) / max(total), 6) as coverage
from (select *, cast(sum(j) over (partition by prot, method order by s, event_id) as bigint) as cluster from (select *, case when s - lag(s) over (partition by prot, method order by s, event_id) <= 10 then 0 else 1 end as j from fx_pred))
join (select prot, method, count(distinct day) as total from fx_pred group by all) using (prot, method) group by prot, method, cluster"""
)
def a22_consensus_per_method(spark, folder):
    keys = ["prot", "method"]
    rows = co.clusters_by_start(fx.predictions(spark, folder), keys, "s", ["event_id"], 10)
    total = rows.groupBy(*keys).agg(F.countDistinct("day").alias("total"))
    found = co.consensus(rows, keys, "s", "e", "day", "method").join(total, keys)
    return found.select(*keys, "cluster", "cons_s", "cons_e", F.round(F.col("n_sequences") / F.col("total"), 6).alias("coverage"))


@query(
    """select t.prot, t.method, t.n_sequences, t.n_domains, c.main as in_main, m.k as usual_count,
round(0.5 * c.main / t.n_sequences + 0.25 * m.times / t.n_sequences + 0.25 * (1 - least((c.sd_s + c.sd_e) / 2, 50.0::double) / 50), 6) as consistency
from (select prot, method, count(distinct day) as n_sequences, count(*) as n_domains from mc group by all) t
join (select *, row_number() over (partition by prot, method order by times desc, k) as r from (select prot, method, k, count(*) as times from (select prot, method, day, count(*) as k from mc group by all) group by all)) m on m.prot = t.prot and m.method = t.method and m.r = 1
join (select *, row_number() over (partition by prot, method order by size desc, cluster) as r from (select prot, method, cluster, count(*) as size, count(distinct day) as main, coalesce(stddev_samp(s), 0) as sd_s, coalesce(stddev_samp(e), 0) as sd_e from mc group by all)) c on c.prot = t.prot and c.method = t.method and c.r = 1""",
    "mc as (select *, cast(sum(j) over (partition by prot, method order by s, event_id) as bigint) as cluster from (select *, case when s - lag(s) over (partition by prot, method order by s, event_id) <= 10 then 0 else 1 end as j from fx_pred))",
)
def a21_method_consistency(spark, folder):
    rows = co.clusters_by_start(fx.predictions(spark, folder), ["prot", "method"], "s", ["event_id"], 10)
    return co.method_consistency(rows, "prot", "method", "day", "s", "e")


@query(
    """select prot, c.cluster as cluster, count(*) as n, min(p.s) as first_s, max(p.e) as last_e from (select prot, unnest(list_reduce(list([{'s': s, 'e': e, 'cluster': 0}] order by s, e), lambda acc, x: list_concat(acc, [{'s': x[1].s, 'e': x[1].e,
'cluster': case when len(list_filter(acc, lambda y: y.cluster = acc[-1].cluster and (abs(y.s - x[1].s) < 10 or abs(y.e - x[1].e) < 10))) > 0 then acc[-1].cluster else acc[-1].cluster + 1 end}]))) as c from (select distinct prot, s, e from fx_pred) group by prot)
join fx_pred p using (prot) where p.s = c.s and p.e = c.e group by prot, c.cluster"""
)
def x33_clusters_by_similarity(spark, folder):
    rows = co.clusters_by_similarity(fx.predictions(spark, folder), "prot", "s", "e", 10)
    return rows.groupBy("prot", "cluster").agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("e").alias("last_e"))


@query(
    f"""select prot, k.s as cons_s, k.e as cons_e, k.score as combined from ({greedy("sc", ["prot"], "{'s': cons_s, 'e': cons_e, 'score': score}", "score desc, cons_s, cons_e",
    "case when greatest(y.s, x[1].s) >= least(y.e, x[1].e) then 0 else (least(y.e, x[1].e) - greatest(y.s, x[1].s) + 1) / least(y.e - y.s + 1, x[1].e - x[1].s + 1) end > 0.5")})""",
    f"{_CL}, sc as (select distinct prot, cons_s, cons_e, round(0.5 * (n_methods / 3.0::double) + 0.5 * (n_sequences / total), 6) as score from agg join tot using (prot))",
)
def x35_non_overlapping_consensus(spark, folder):
    total = fx.predictions(spark, folder).groupBy("prot").agg(F.countDistinct("day").alias("total"))
    rows = co.scored(_consensus(spark, folder).join(total, "prot"), "total")
    return co.without_overlaps(rows, "prot", "cons_s", "cons_e", "combined")


@query(
    """select prot, min(idx) as seg_s, max(idx) as seg_e, count(*) as n from (select prot, idx, sum(f) over (partition by prot order by idx) as run from (select prot, idx, case when idx - lag(idx) over (partition by prot order by idx) <= 3 then 0 else 1 end as f from fx_res where plddt >= 60)) group by prot, run"""
)
def w05_contiguous_segments(spark, folder):
    return runs(fx.residues(spark, folder).where("plddt >= 60"), ["prot"], "idx", 3)


@query(
    """select acc, min(seq_start) as seg_s, max(seq_end) as seg_e, count(*) as n from (select *, sum(f) over (partition by acc order by seq_start, seq_end rows between unbounded preceding and current row) as run from (select acc, seq_start, seq_end,
case when seq_start - max(seq_end) over (partition by acc order by seq_start, seq_end rows between unbounded preceding and 1 preceding) <= 5 then 0 else 1 end as f from fx_family)) group by acc, run"""
)
def w06_merged_segments(spark, folder):
    return merged(fx.family_regions(spark, folder), ["acc"], "seq_start", "seq_end", 5)


@query("select prot, method, s, e, round(greatest(0::double, 1 - abs(s - ms) / 10.0::double) / 2 + greatest(0::double, 1 - abs(e - me) / 10.0::double) / 2, 6) as similarity from fx_pred join (select prot as p, cast(floor(median(s)) as bigint) as ms, cast(floor(median(e)) as bigint) as me from fx_pred group by prot) on p = prot")
def p24_boundary_similarity(spark, folder):
    middle = lambda c: F.floor(F.percentile(c, F.lit(0.5))).cast("bigint")
    medians = fx.predictions(spark, folder).groupBy("prot").agg(middle("s").alias("ms"), middle("e").alias("me"))
    score = iv.boundary_similarity("s", "ms", 10) / 2 + iv.boundary_similarity("e", "me", 10) / 2
    return fx.predictions(spark, folder).join(medians, "prot").select("prot", "method", "s", "e", F.round(score, 6).alias("similarity"))


@query("select line_id, regexp_replace(aln, '[.-]', '', 'g') as seq, length(aln) as width, first, last, last - first + 1 = length(regexp_replace(aln, '[.-]', '', 'g')) as fits from fx_align")
def s17_alignment_scan(spark, folder):
    letters = F.regexp_replace("aln", "[.-]", "")
    rows = fx.alignment(spark, folder)
    return rows.select("line_id", letters.alias("seq"), F.length("aln").cast("bigint").alias("width"), "first", "last", (F.col("last") - F.col("first") + 1 == F.length(letters)).alias("fits"))


@query("select family, line_id, concat(acc, '/', first, '-', last, ' ', aln) as line from fx_align where family is not null")
def k03_lines_per_family(spark, folder):
    """The lines to be written with partitionBy('family'), one folder for each family."""
    line = F.concat("acc", F.lit("/"), "first", F.lit("-"), "last", F.lit(" "), "aln")
    return fx.alignment(spark, folder).where("family is not null").select("family", "line_id", line.alias("line"))
