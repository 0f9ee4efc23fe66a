"""Prediction of domains step by step: seeds, growth, merges, searches, cuts, and the filters after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.operators import merging as mg
from foldloom.operators import partition as pt
from foldloom.operators import structure as st
from foldloom.operators import voronoi as vo
from foldloom.operators.sequences import identity_ladder
from foldloom.plans.partitions import w11_split_candidates
from foldloom.plans.registry import Plans, greedy
from foldloom.plans.structure import _E, REACH, SIGMA, _edges, _members
from foldloom.sources import fixtures as fx
from foldloom.sources.lines import aligned_errors

query = Plans()
QUERIES, ORACLES = query.queries, query.oracles


@query(
    "select distinct prot, idx from (select *, row_number() over (partition by prot, gx, gy, gz order by round((dx - gx * 20) * (dx - gx * 20) + (dy - gy * 20) * (dy - gy * 20) + (dz - gz * 20) * (dz - gz * 20), 6), idx) as k from corner) where k = 1",
    """low as (select prot, min(x) as lx, min(y) as ly, min(z) as lz from fx_res group by prot),
corner as (select r.prot, r.idx, r.x - lx as dx, r.y - ly as dy, r.z - lz as dz, floor((r.x - lx) / 20.0) + a as gx, floor((r.y - ly) / 20.0) + b as gy, floor((r.z - lz) / 20.0) + c as gz
  from fx_res r join low using (prot), unnest([0, 1]) as u(a), unnest([0, 1]) as v(b), unnest([0, 1]) as w(c) where r.plddt >= 60)""",
)
def x23_grid_seeds(spark, folder):
    return st.seeds_by(fx.residues(spark, folder), "grid", spacing=20.0, min_plddt=60.0)


@query(
    f"""select prot, k.idx as idx from (select prot, k, row_number() over (partition by prot order by k.r) as place from ({greedy("cand", ["prot"], "{'idx': idx, 'r': r, 'px': px, 'py': py, 'pz': pz}", "r, idx",
    "sqrt((y.px - x[1].px) * (y.px - x[1].px) + (y.py - x[1].py) * (y.py - x[1].py) + (y.pz - x[1].pz) * (y.pz - x[1].pz)) < 15")})) where place <= 5""",
    "cand as (select prot, idx, x as px, y as py, z as pz, md5(concat('42/', prot, '/', idx)) as r from fx_res where plddt >= 60)",
)
def x23_random_seeds(spark, folder):
    return st.seeds_by(fx.residues(spark, folder), "random", min_plddt=60.0)


@query()
def x24_surviving_domains(spark, folder):
    """Growth from peaks in which domains of less than three residues die."""
    seeds = st.seeds_by(fx.residues(spark, folder), "plddt_peaks").withColumn("dom", F.col("idx"))
    return st.grown(_edges(spark, folder), seeds, 0.02, min_size=3)


_PAE = """pae as (select a.prot, a.idx as i, b.idx as j, a.plddt as pi, b.plddt as pj, round(least(31.75::double, abs(a.plddt - b.plddt) / 3 + abs(a.idx - b.idx) / 10.0::double), 2) as pae
  from fx_res a join fx_res b on b.prot = a.prot where a.idx <> b.idx)"""


def _errors(spark, folder):
    """Aligned errors out of the lines of a protein's matrix: prot, i, j, pae, without the diagonal."""
    residues = fx.residues(spark, folder).select("prot", "idx", "plddt")
    listed = residues.groupBy("prot").agg(F.sort_array(F.collect_list(F.struct("idx", "plddt"))).alias("all"))
    error = lambda o: F.round(F.least(F.lit(31.75), F.abs(F.col("plddt") - o["plddt"]) / 3 + F.abs(F.col("idx") - o["idx"]) / 10.0), 2)
    lines = residues.join(listed, "prot").select("prot", F.col("idx").alias("at"), F.to_json(F.struct(F.array(F.transform("all", error)).alias("predicted_aligned_error"))).alias("line"))
    return aligned_errors(lines).where("at <> j").select("prot", F.col("at").alias("i"), "j", "pae")


@query(
    """select *, round(case when median < 6 then least(upper, 8.0::double) else greatest(1.6::double, least(16.0::double, 8.0::double * median / 5)) end, 6) as threshold
from (select prot, round(quantile_cont(pae, 0.5), 6) as median, round(quantile_cont(pae, 0.75), 6) as upper, count(*) as n from pae where pi >= 40 and pj >= 40 group by prot)""",
    _PAE,
)
def a33_error_percentiles(spark, folder):
    """Of the errors between confident residues, and the threshold of merges adapted to them."""
    sure = fx.residues(spark, folder).where("plddt >= 40").select("prot", F.col("idx").alias("i"))
    rows = _errors(spark, folder).join(sure, ["prot", "i"], "left_semi").join(sure.withColumnRenamed("i", "j"), ["prot", "j"], "left_semi").groupBy("prot")
    found = rows.agg(F.round(F.percentile("pae", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("pae", F.lit(0.75)), 6).alias("upper"), F.count("*").alias("n"))
    return found.withColumn("threshold", F.round(mg.adapted_threshold(F.col("median"), F.col("upper"), 8.0), 6))


@query(
    "select p.prot, least(a.dom, b.dom) as dom_a, greatest(a.dom, b.dom) as dom_b, round(avg(p.pae), 6) as mean_error, count(*) as n from pae p join mem a on a.prot = p.prot and a.idx = p.i join mem b on b.prot = p.prot and b.idx = p.j group by all",
    f"{_E}, {_PAE}",
)
def a34_errors_by_domain(spark, folder):
    """Mean errors inside each domain and between each two."""
    pairs = mg.domain_pairs(_errors(spark, folder), _members(spark, folder))
    return pairs.select("prot", F.col("a").alias("dom_a"), F.col("b").alias("dom_b"), F.round(F.col("sum") / F.col("n"), 6).alias("mean_error"), "n")


def _merged(spark, folder, strategy, threshold, distance=5.0):
    residues, members = fx.residues(spark, folder), _members(spark, folder)
    near = st.contacts(residues, distance) if strategy == "spatial_merge" else None
    pairs = mg.domain_pairs(_errors(spark, folder), members, near)
    return mg.merged_domains(pairs, members.groupBy("prot", "dom").agg(F.count("*").alias("n")), strategy, threshold, distance)


@query()
def x25_simple_merge(spark, folder):
    return _merged(spark, folder, "simple_merge", 9.5)


@query()
def x25_size_weighted(spark, folder):
    return _merged(spark, folder, "size_weighted", 9.5)


@query()
def x25_boundary_strength(spark, folder):
    return _merged(spark, folder, "boundary_strength", 1.0)


@query()
def x25_spatial_merge(spark, folder):
    return _merged(spark, folder, "spatial_merge", 10.0, 10.0)


@query()
def x26_consolidated_members(spark, folder):
    """Predicted ranges merged by overlap: at 0.8 first, then at 0.5."""
    return mg.consolidated(fx.predictions(spark, folder), "prot", "s", "e")


@query()
def x18_bisected_domains(spark, folder):
    return pt.bisected(_edges(spark, folder), min_size=5, max_conductance=0.9, max_connectivity=1.0)


@query()
def x20_candidate_segments(spark, folder):
    """X20 with domains that begin at candidates of the spectral cuts only."""
    residues = fx.residues(spark, folder)
    lengths = residues.groupBy("prot").agg(F.max("idx").alias("n"))
    return pt.best_segments(_edges(spark, folder), lengths, [0.0, 0.05, 0.2], 5, candidates=w11_split_candidates(spark, folder))


@query()
def x29_climbed_partition(spark, folder):
    """X29: spread start, restarts and climb for three domains."""
    found = vo.best_partition(fx.residues(spark, folder), _edges(spark, folder), [3], vo.chain_score(min_size=10), climbing=True)
    return found.select("prot", "idx", "dom", F.round("score", 4).alias("score"))


@query()
def x30_best_partition(spark, folder):
    """X30: the number of domains of best score."""
    found = vo.best_partition(fx.residues(spark, folder), _edges(spark, folder), [1, 2, 3, 4, 5, 6], vo.compact_score())
    return found.select("prot", "idx", "dom", "k", F.round("score", 4).alias("score"))


@query(
    "select r.prot, r.idx from fx_res r left join (select prot, idx, count(*) as k from (select prot, i as idx from e where j - i >= 10 union all select prot, j from e where j - i >= 10) group by all) g using (prot, idx) where coalesce(g.k, 0) < 3",
    _E,
)
def x04_isolated_residues(spark, folder):
    return st.isolated(fx.residues(spark, folder), _edges(spark, folder))


@query(
    """select s.prot, s.dom, s.n from (select prot, dom, count(*) as n, avg(plddt) as mean, coalesce(max(gap), 0) as gap from (select *, idx - lag(idx) over (partition by prot, dom order by idx) as gap from lo) group by prot, dom) s
left join (select prot, di as dom, count(*) as inner_ from le where di = dj group by all) x using (prot, dom)
left join (select prot, dom, count(*) as outer_ from (select prot, di as dom from le where di is distinct from dj union all select prot, dj from le where di is distinct from dj) where dom is not null group by all) y using (prot, dom)
where s.n >= 5 and s.mean >= 30 and s.gap <= 20 and (case when coalesce(outer_, 0) > 0 then coalesce(inner_, 0) / outer_ else coalesce(inner_, 0) end >= 0.3 or 2 * coalesce(inner_, 0) / s.n >= 3)""",
    f"{_E}, lo as (select prot, idx, dom, plddt from mem where plddt < 60), le as (select e.prot, a.dom as di, b.dom as dj from e left join lo a on a.prot = e.prot and a.idx = e.i left join lo b on b.prot = e.prot and b.idx = e.j)",
)
def x06_rescued_domains(spark, folder):
    """Clusters of unordered residues that are domains by confidence, gaps and contacts."""
    residues = fx.residues(spark, folder)
    return st.rescued(residues, _edges(spark, folder), residues.where("plddt < 60"), _members(spark, folder), min_size=5, min_plddt=30, min_ratio=0.3)


@query(
    """select n.prot, coalesce(t.n_triangles, 0) as n_triangles, round(coalesce(c.s, 0) / n.n, 6) as clustering, n.n - coalesce(g.linked, 0) + coalesce(g.parts, 0) as n_components from (select prot, count(*) as n from fx_res group by prot) n
left join (select prot, count(*) as n_triangles from tri group by prot) t using (prot)
left join (select x.prot, sum(2 * x.share / (k.k * (k.k - 1))) as s from (select tri.prot, unnest([x, y, z]) as idx, cbrt(w1 * w2 * w3) / top as share from tri join (select prot, max(w) as top from e group by prot) m on m.prot = tri.prot) x
  join deg k on k.prot = x.prot and k.idx = x.idx group by x.prot) c using (prot)
left join (select prot, count(*) as linked, count(distinct first) as parts from (select prot, a, min(b) as first from reach group by prot, a) group by prot) g using (prot)""",
    f"""{_E}, tri as (select a.prot, a.i as x, a.j as y, b.j as z, a.w as w1, b.w as w2, c.w as w3 from e a join e b on b.prot = a.prot and b.i = a.j join e c on c.prot = a.prot and c.i = a.i and c.j = b.j),
deg as (select prot, idx, count(*) as k from (select prot, i as idx from e union all select prot, j from e) group by all),
lk as (select prot, i as a, j as b from e union select prot, j, i from e), reach as (select distinct prot, a, a as b from lk union select r.prot, r.a, l.b from reach r join lk l on l.prot = r.prot and l.a = r.b)""",
)
def a24_clustering(spark, folder):
    """Triangles, mean clustering coefficient and connected components of the contacts of a protein."""
    nodes, edges = fx.residues(spark, folder).select("prot", "idx"), _edges(spark, folder)
    parts = st.components(edges.select("prot", F.col("i").alias("a"), F.col("j").alias("b")), "prot", "a", "b").groupBy("prot").agg(F.count("*").alias("linked"), F.countDistinct("first").alias("parts"))
    sizes = nodes.groupBy("prot").agg(F.count("*").alias("n"))
    rows = sizes.join(st.mean_clustering(edges, nodes), "prot").join(parts, "prot", "left").fillna(0, ["linked", "parts"])
    return rows.select("prot", "n_triangles", F.round("clustering", 6).alias("clustering"), (F.col("n") - F.col("linked") + F.col("parts")).alias("n_components"))


@query("select a.prot, a.dom, round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 5) as max_dimension from mem a join mem b on b.prot = a.prot and b.dom = a.dom group by a.prot, a.dom", _E)
def a25_largest_dimension(spark, folder):
    return st.largest_dimension(fx.residues(spark, folder), _members(spark, folder)).withColumn("max_dimension", F.round("max_dimension", 5))


@query(
    """select prot, dom, round(least(50.0::double, mean_plddt / 2) + (case when external = 0 then (case when internal > 0 then 25.0::double else 0 end) else least(25.0::double, internal / external * 5) end)
+ (case when rg / sqrt(size) < 3 then 15 when rg / sqrt(size) < 5 then 10 when rg / sqrt(size) < 7 then 5 else 0 end) + 10 * coverage, 5) as score, round(coverage, 6) as coverage from gs join gf using (prot, dom)""",
    f"""{_E}, gm as (select * from mem where plddt >= 40), ge as (select e.prot, e.w, a.dom as di, b.dom as dj from e left join gm a on a.prot = e.prot and a.idx = e.i left join gm b on b.prot = e.prot and b.idx = e.j),
gf as (select prot, dom, sum(case when di = dj then w / 2 else 0 end) as internal, sum(case when di is distinct from dj then w else 0 end) as external from (select prot, di as dom, di, dj, w from ge union all select prot, dj, di, dj, w from ge union all select distinct prot, dom, dom, dom, 0 from gm) where dom is not null group by prot, dom),
gs as (select prot, dom, count(*) as size, count(*) / (max(idx) - min(idx) + 1) as coverage, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) as rg, avg(plddt) as mean_plddt from gm group by prot, dom)""",
)
def p29_quality_of_gapped(spark, folder):
    """Quality of domains that don't fill their span."""
    members = _members(spark, folder).where("plddt >= 40")
    span = members.groupBy("prot", "dom").agg((F.count("*") / (F.max("idx") - F.min("idx") + 1)).alias("coverage"))
    shape = st.compactness(fx.residues(spark, folder), members).drop("size")
    rows = shape.join(st.contact_figures(_edges(spark, folder), members), ["prot", "dom"]).join(span, ["prot", "dom"])
    score = st.quality_score(F.col("mean_plddt"), F.col("ratio"), F.col("rg"), F.col("size"), F.col("coverage"))
    return rows.select("prot", "dom", F.round(score, 5).alias("score"), F.round("coverage", 6).alias("coverage"))


@query("select prot, dom, s, e from (select prot, dom, min(idx) filter (plddt >= 60) as s, max(idx) filter (plddt >= 60) as e from mem group by prot, dom) where e - s + 1 >= 3", _E)
def x22_trimmed_domains(spark, folder):
    domains = _members(spark, folder).groupBy("prot", "dom").agg(F.min("idx").alias("s"), F.max("idx").alias("e"))
    return st.trimmed_to_structured(fx.residues(spark, folder), domains, 60, 3)


@query()
def x31_postprocessed_domains(spark, folder):
    """Small domains merged into neighbours, then without those of poor contact ratio or too few residues."""
    labels = fx.residues(spark, folder).select("prot", "idx", F.floor(F.col("plddt") / 20).cast("int").alias("dom"))
    edges = _edges(spark, folder)
    members = st.with_small_merged(edges, labels, 8)
    good = st.contact_figures(edges.select("prot", "i", "j", F.lit(1.0).alias("w")), members).where("size >= 8 and ratio >= 0.1").select("prot", "dom")
    return members.join(good, ["prot", "dom"], "left_semi").select("prot", "idx", "dom")


@query()
def x40_identity_ladder(spark, folder):
    """Representatives at 80 % identity; families left with one go up in steps of 5 % until they have more."""
    return identity_ladder(fx.alignment(spark, folder), "family", "line_id", "aln")


@query()
def x16_domains_in_stages(spark, folder):
    """X16: all stages, from contacts to extension."""
    return st.predicted_in_stages(fx.residues(spark, folder), REACH, SIGMA, cutoff=40, min_size=3, min_ratio=0.01, max_rg=4.0)
