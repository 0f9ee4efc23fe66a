"""Contacts, order and domains of structures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldloom.operators import structure as st
from foldloom.operators.islands import runs
from foldloom.plans.registry import Plans
from foldloom.sources import fixtures as fx
from foldloom.sources.lines import aligned_errors, atoms, hydrogen_bonds, secondary_structure, table_atoms

query = Plans()
QUERIES, ORACLES = query.queries, query.oracles

REACH, SIGMA, BLOCK = 25.0, 20.0, 25

_E = f"""con as (select a.prot, a.idx as i, b.idx as j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as d, a.plddt as pi, b.plddt as pj
  from fx_res a join fx_res b on a.prot = b.prot and b.idx - a.idx >= 3),
e as (select prot, i, j, d, pi * pj / 10000.0::double * exp(-d * d / {SIGMA * SIGMA}::double) as w from con where d <= {REACH}),
mem as (select prot, idx, x, y, z, plddt, cast((idx - 1) // {BLOCK} as integer) as dom from fx_res),
ee as (select e.*, a.dom as di, b.dom as dj from e join mem a on a.prot = e.prot and a.idx = e.i join mem b on b.prot = e.prot and b.idx = e.j),
fig as (select m.prot, m.dom, count(*) as size, coalesce(max(q.internal), 0) as internal, coalesce(max(q.external), 0) as external from mem m left join (
  select prot, dom, sum(case when di = dj then w / 2 else 0 end) as internal, sum(case when di <> dj then w else 0 end) as external from (select prot, di as dom, di, dj, w from ee union all select prot, dj, di, dj, w from ee) group by prot, dom) q
  on q.prot = m.prot and q.dom = m.dom group by m.prot, m.dom),
shape as (select prot, dom, count(*) as size, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) as rg, avg(plddt) as mean_plddt, min(plddt) as min_plddt, stddev_pop(plddt) as sd_plddt from mem group by prot, dom)"""


def _edges(spark, folder):
    residues = fx.residues(spark, folder)
    return st.weighted(st.contacts(residues, REACH, 3), residues, SIGMA)


def _members(spark, folder):
    return fx.residues(spark, folder).withColumn("dom", F.expr(f"cast((idx - 1) div {BLOCK} as int)"))


def _figures(spark, folder):
    return st.contact_figures(_edges(spark, folder), _members(spark, folder))


@query("select prot, i, j, round(d, 6) as d from con where d <= 10 and j - i >= 6", _E)
def j19_contacts(spark, folder):
    return st.contacts(fx.residues(spark, folder), 10.0, 6).withColumn("d", F.round("d", 6))


@query("select prot, k as reach, count(*) as n from con, unnest([8, 10, 12, 15]) as u(k) where d > 0 and d < k group by all", _E)
def x13_contacts_by_threshold(spark, folder):
    """J20 and X13: contacts within each of several distances, from one join."""
    rows = st.contacts(fx.residues(spark, folder), 15.0, 3).where("d > 0")
    return rows.select("prot", "d", F.explode(F.array(*map(F.lit, (8, 10, 12, 15)))).alias("reach")).where("d < reach").groupBy("prot", "reach").agg(F.count("*").alias("n"))


@query("select prot, i, j, round(w, 6) as w from e", _E)
def p27_edge_weights(spark, folder):
    return _edges(spark, folder).select("prot", "i", "j", F.round("w", 6).alias("w"))


_B = f"{_E}, bond as (select prot, i, j, -d / 20 as energy from con where d between 20 and 30)"


@query(
    """select coalesce(e.prot, b.prot) as prot, coalesce(e.i, b.i) as i, coalesce(e.j, b.j) as j, round(coalesce(e.w, 0) + case when b.energy is null then 0 else 0.5 * least(1.0::double, abs(b.energy) / 2) end, 6) as w, b.energy is not null as bonded
from e full join bond b on b.prot = e.prot and b.i = e.i and b.j = e.j""",
    _B,
)
def j21_bonds_on_edges(spark, folder):
    residues = fx.residues(spark, folder)
    bonds = st.contacts(residues, 30.0, 3).where("d >= 20").select("prot", "i", "j", (-F.col("d") / 20).alias("energy"))
    return st.with_bonds(_edges(spark, folder).select("prot", "i", "j", "w"), bonds).withColumn("w", F.round("w", 6))


@query("select prot, dom, size, round(internal, 6) as internal, round(external, 6) as external, round(case when size < 2 then 0 else internal / (size * (size - 1) / 2) end, 8) as density from fig", _E)
def a23_contact_figures(spark, folder):
    return _figures(spark, folder).select("prot", "dom", "size", F.round("internal", 6).alias("internal"), F.round("external", 6).alias("external"), F.round("density", 8).alias("density"))


@query(
    """select n.prot, n.n_nodes, coalesce(k.n_edges, 0) as n_edges, round(2.0::double * coalesce(k.n_edges, 0) / n.n_nodes, 6) as mean_degree, round(2.0::double * coalesce(k.n_edges, 0) / (n.n_nodes * (n.n_nodes - 1)), 8) as density, round(k.mean_w, 6) as mean_weight,
coalesce(t.n_triangles, 0) as n_triangles from (select prot, count(*) as n_nodes from fx_res group by prot) n left join (select prot, count(*) as n_edges, avg(w) as mean_w from e group by prot) k using (prot)
left join (select a.prot, count(*) as n_triangles from e a join e b on b.prot = a.prot and b.i = a.j join e c on c.prot = a.prot and c.i = a.i and c.j = b.j group by a.prot) t using (prot)""",
    _E,
)
def a24_graph_statistics(spark, folder):
    edges = _edges(spark, folder).select("prot", "i", "j", "w")
    nodes = fx.residues(spark, folder).groupBy("prot").agg(F.count("*").alias("n_nodes"))
    sums = edges.groupBy("prot").agg(F.count("*").alias("n_edges"), F.avg("w").alias("mean_w"))
    closed = st.triangles(edges).groupBy("prot").agg(F.count("*").alias("n_triangles"))
    n, m = F.col("n_nodes"), F.coalesce("n_edges", F.lit(0))
    return nodes.join(sums, "prot", "left").join(closed, "prot", "left").select(
        "prot", "n_nodes", m.alias("n_edges"), F.round(2.0 * m / n, 6).alias("mean_degree"), F.round(2.0 * m / (n * (n - 1)), 8).alias("density"), F.round("mean_w", 6).alias("mean_weight"), F.coalesce("n_triangles", F.lit(0)).alias("n_triangles")
    )


@query("select prot, dom, size, round(rg, 5) as rg, round(mean_plddt, 5) as mean_plddt, round(min_plddt, 5) as min_plddt, round(sd_plddt, 5) as sd_plddt from shape", _E)
def a25_compactness(spark, folder):
    rows = st.compactness(fx.residues(spark, folder), _members(spark, folder))
    return rows.select("prot", "dom", "size", *[F.round(c, 5).alias(c) for c in ("rg", "mean_plddt", "min_plddt", "sd_plddt")])


@query(
    """select s.prot, s.dom, round(least(50.0::double, s.mean_plddt / 2) + (case when f.external = 0 then (case when f.internal > 0 then 25.0::double else 0 end) else least(25.0::double, f.internal / f.external * 5) end)
+ (case when s.rg / sqrt(s.size) < 3 then 15 when s.rg / sqrt(s.size) < 5 then 10 when s.rg / sqrt(s.size) < 7 then 5 else 0 end) + 10, 5) as score from shape s join fig f on f.prot = s.prot and f.dom = s.dom""",
    _E,
)
def p29_quality_score(spark, folder):
    shape = st.compactness(fx.residues(spark, folder), _members(spark, folder)).drop("size")
    rows = shape.join(_figures(spark, folder), ["prot", "dom"])
    score = st.quality_score(F.col("mean_plddt"), F.col("ratio"), F.col("rg"), F.col("size"), F.lit(1.0))
    return rows.select("prot", "dom", F.round(score, 5).alias("score"))


@query(
    """select s.prot, s.dom, s.size, round(1.5 * (case when s.size <= 50 then 1.0::double when s.size <= 100 then 0.8 when s.size <= 200 then 0.7 else 0.6 end) * (case when s.mean_plddt >= 90 then 0.5 when s.mean_plddt >= 80 then 0.7 else 1.0 end), 6) as threshold,
round(2.5 * power(s.size, 1.0::double / 3), 5) as expected_rg, round(2.5 * power(s.size, 0.4::double), 5) as expected_rg_long from shape s""",
    _E,
)
def p34_thresholds_by_size(spark, folder):
    """P34 and P35."""
    rows = st.compactness(fx.residues(spark, folder), _members(spark, folder))
    n = F.col("size")
    limit = st.ratio_threshold(1.5, n, F.col("mean_plddt"))
    return rows.select("prot", "dom", "size", F.round(limit, 6).alias("threshold"), F.round(2.5 * F.pow(n, F.lit(1.0 / 3)), 5).alias("expected_rg"), F.round(2.5 * F.pow(n, F.lit(0.4)), 5).alias("expected_rg_long"))


_LR = f"{_E}, lr as (select prot, di as dom, count(*) as n from ee where di = dj and j - i >= 10 group by prot, di)"


@query("select f.prot, f.dom, coalesce(l.n, 0) as n_long, round(coalesce(l.n, 0) / f.size, 6) as per_residue from fig f left join lr l on l.prot = f.prot and l.dom = f.dom", _LR)
def a31_long_range_contacts(spark, folder):
    m = _members(spark, folder).select("prot", "idx", "dom")
    ends = _edges(spark, folder).where("j - i >= 10").join(m.withColumnsRenamed({"idx": "i", "dom": "di"}), ["prot", "i"]).join(m.withColumnsRenamed({"idx": "j", "dom": "dj"}), ["prot", "j"])
    counts = ends.where("di = dj").groupBy("prot", F.col("di").alias("dom")).agg(F.count("*").alias("n"))
    sizes = m.groupBy("prot", "dom").agg(F.count("*").alias("size")).join(counts, ["prot", "dom"], "left")
    n = F.coalesce("n", F.lit(0))
    return sizes.select("prot", "dom", n.alias("n_long"), F.round(n / F.col("size"), 6).alias("per_residue"))


@query(
    """select f.prot, f.dom, f.size >= 20 as large_enough, f.external = 0 or f.internal / f.external >= 0.2 as ratio_ok, s.rg <= 2 * 2.5 * power(s.size, 1.0::double / 3) as compact, coalesce(l.n, 0) / f.size >= 0.5 as connected
from fig f join shape s on s.prot = f.prot and s.dom = f.dom left join lr l on l.prot = f.prot and l.dom = f.dom""",
    _LR,
)
def x11_quality_filters(spark, folder):
    """X11 and X28: which filters a domain passes."""
    shape = st.compactness(fx.residues(spark, folder), _members(spark, folder)).select("prot", "dom", "rg")
    rows = _figures(spark, folder).join(shape, ["prot", "dom"]).join(a31_long_range_contacts(spark, folder), ["prot", "dom"])
    return rows.select(
        "prot",
        "dom",
        (F.col("size") >= 20).alias("large_enough"),
        ((F.col("external") == 0) | (F.col("ratio") >= 0.2)).alias("ratio_ok"),
        (F.col("rg") <= 2 * 2.5 * F.pow("size", F.lit(1.0 / 3))).alias("compact"),
        (F.col("n_long") / F.col("size") >= 0.5).alias("connected"),
    )


@query("select prot, cast((j - i) // 5 * 5 as bigint) as bucket, count(*) as n from e group by all", _E)
def a32_separation_histogram(spark, folder):
    return _edges(spark, folder).groupBy("prot", F.expr("(j - i) div 5 * 5").cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


@query("select prot, round(quantile_cont(d, 0.5), 5) as median, round(quantile_cont(d, 0.75), 5) as upper, count(*) as n from con group by prot", _E)
def a33_distance_percentiles(spark, folder):
    a = fx.residues(spark, folder)
    b = a.select("prot", F.col("idx").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    d = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) + (F.col("z") - F.col("z2")) * (F.col("z") - F.col("z2")))
    rows = a.join(b, "prot").where("j - idx >= 3").select("prot", d.alias("d")).groupBy("prot")
    return rows.agg(F.round(F.percentile("d", F.lit(0.5)), 5).alias("median"), F.round(F.percentile("d", F.lit(0.75)), 5).alias("upper"), F.count("*").alias("n"))


@query("select prot, di = dj as same_domain, round(avg(d), 6) as mean_error, count(*) as n from ee group by all", _E)
def a34_error_inside_and_between(spark, folder):
    m = _members(spark, folder).select("prot", "idx", "dom")
    ends = _edges(spark, folder).join(m.withColumnsRenamed({"idx": "i", "dom": "di"}), ["prot", "i"]).join(m.withColumnsRenamed({"idx": "j", "dom": "dj"}), ["prot", "j"])
    return ends.groupBy("prot", (F.col("di") == F.col("dj")).alias("same_domain")).agg(F.round(F.avg("d"), 6).alias("mean_error"), F.count("*").alias("n"))


@query(
    """select d.prot, round(sum((coalesce(a.a, 0) - d.k * d.k / (4.0::double * t.m)) / t.m), 6) as q from (select m.prot, m.dom, cast(sum(g.k) as double) as k from mem m join (select prot, idx, count(*) as k from (select prot, i as idx from e union all select prot, j from e) group by all) g on g.prot = m.prot and g.idx = m.idx group by m.prot, m.dom) d
join (select prot, count(*) as m from e group by prot) t on t.prot = d.prot left join (select prot, di as dom, count(*) as a from ee where di = dj group by prot, di) a on a.prot = d.prot and a.dom = d.dom group by d.prot""",
    _E,
)
def a35_modularity(spark, folder):
    return st.modularity(_edges(spark, folder), _members(spark, folder)).withColumn("q", F.round("q", 6))


@query(
    """select s.prot, s.dom, round(case when least(s.vol, t.total - s.vol) <= 1e-12 then 1 else s.cut / least(s.vol, t.total - s.vol) end, 6) as conductance from (select prot, dom, sum(w) as vol, sum(case when di <> dj then w else 0 end) as cut
from (select prot, di as dom, di, dj, w from ee union all select prot, dj, di, dj, w from ee) group by prot, dom) s join (select prot, 2 * sum(w) as total from e group by prot) t on t.prot = s.prot""",
    _E,
)
def a36_conductance(spark, folder):
    return st.conductance(_edges(spark, folder), _members(spark, folder)).withColumn("conductance", F.round("conductance", 6))


_BR = f"{_E}, br as (select prot, min(i) as start, max(j) as \"end\", sum(w) as strength, count(*) as n_contacts from e where j - i >= 10 group by prot, i // 10, j // 10 having count(*) >= 5 and sum(w) >= 0.1)"


def _bridges(spark, folder):
    return st.bridges(_edges(spark, folder), 10, 10, 5, 0.1)


@query('select prot, start, "end", round(strength, 6) as strength, n_contacts from br', _BR)
def a30_bridges(spark, folder):
    return _bridges(spark, folder).withColumn("strength", F.round("strength", 6))


@query(
    """select s.prot, s.start, s."end", o.start as parent_start, o."end" as parent_end from (select distinct prot, start, "end" from br) s left join (select i.prot, i.start as a, i."end" as b, o.start, o."end", row_number() over (partition by i.prot, i.start, i."end" order by o."end" - o.start, o.start, o."end") as k
from (select distinct prot, start, "end" from br) i join (select distinct prot, start, "end" from br) o on o.prot = i.prot and o.start <= i.start and i."end" <= o."end" and (o.start < i.start or i."end" < o."end")) o on o.prot = s.prot and o.a = s.start and o.b = s."end" and o.k = 1""",
    _BR,
)
def j23_smallest_container(spark, folder):
    return st.smallest_container(_bridges(spark, folder))


@query(
    """select prot, idx, dom from (select r.prot, r.idx, s.dom, row_number() over (partition by r.prot, r.idx order by (r.x - s.sx) * (r.x - s.sx) + (r.y - s.sy) * (r.y - s.sy) + (r.z - s.sz) * (r.z - s.sz), s.dom) as k
from fx_res r join (select prot, dom, round(avg(x), 6) as sx, round(avg(y), 6) as sy, round(avg(z), 6) as sz from mem group by prot, dom) s on s.prot = r.prot) where k = 1""",
    _E,
)
def j22_nearest_seed(spark, folder):
    return st.nearest_seed(fx.residues(spark, folder), _seeds(spark, folder))


def _seeds(spark, folder):
    return _members(spark, folder).groupBy("prot", "dom").agg(*[F.round(F.avg(a), 6).alias(f"s{a}") for a in "xyz"])


_DIS = """w as (select *, count(*) over a as n, avg(plddt) over a as m, min(plddt) over a as low from fx_res window a as (partition by prot order by idx rows between current row and 9 following)),
v as (select *, max(case when n = 10 and m < 50 and low < 50 then 1 else 0 end) over (partition by prot order by idx rows between 9 preceding and current row) as win,
  min(case when plddt < 60 then 1 else 0 end) over (partition by prot order by idx rows between unbounded preceding and current row) as head, min(case when plddt < 60 then 1 else 0 end) over (partition by prot order by idx rows between current row and unbounded following) as foot,
  count(*) over (partition by prot) as size from w),
dis as (select prot, idx, plddt, win = 1 as low_window, plddt < 40 as very_low, (head = 1 and idx <= 30) or (foot = 1 and idx > size - 30) as tail from v)"""


def _disorder(spark, folder):
    return st.disorder(fx.residues(spark, folder), 70)


@query("select prot, idx, low_window, very_low, tail from dis", _DIS)
def w07_disordered_residues(spark, folder):
    """W07 and W08."""
    return _disorder(spark, folder).select("prot", "idx", "low_window", "very_low", "tail")


@query("select prot, min(idx) as seg_s, max(idx) as seg_e, count(*) as n from (select *, sum(f) over (partition by prot order by idx) as run from (select prot, idx, case when idx - lag(idx) over (partition by prot order by idx) <= 1 then 0 else 1 end as f from dis where low_window or very_low or tail)) group by prot, run", _DIS)
def x04_disordered_regions(spark, folder):
    return runs(_disorder(spark, folder).where("low_window or very_low or tail"), ["prot"], "idx", 1)


@query(
    """select r.prot, r.seg_s, r.seg_e, case when r.seg_s <= 10 or r.seg_e > s.size - 10 then 'terminal' when r.m < 50 then 'disordered' when r.degree / r.n < 2 then 'isolated' else 'linker' end as kind
from (select q.prot, min(q.idx) as seg_s, max(q.idx) as seg_e, count(*) as n, avg(q.plddt) as m, sum(coalesce(g.k, 0)) as degree from (select *, sum(f) over (partition by prot order by idx) as run from (select *, case when idx - lag(idx) over (partition by prot order by idx) <= 1 then 0 else 1 end as f from dis where low_window or very_low or tail)) q
left join (select prot, idx, count(*) as k from (select prot, i as idx from e union all select prot, j from e) group by all) g on g.prot = q.prot and g.idx = q.idx group by q.prot, q.run) r join (select prot, max(idx) as size from fx_res group by prot) s on s.prot = r.prot""",
    f"{_E}, {_DIS}",
)
def x05_disorder_classes(spark, folder):
    flagged = _disorder(spark, folder).where("low_window or very_low or tail")
    degree = _edges(spark, folder).select("prot", F.explode(F.array("i", "j")).alias("idx")).groupBy("prot", "idx").agg(F.count("*").alias("k"))
    by = Window.partitionBy("prot").orderBy("idx")
    rows = flagged.withColumn("f", F.when(F.col("idx") - F.lag("idx").over(by) <= 1, 0).otherwise(1)).withColumn("run", F.sum("f").over(by)).join(degree, ["prot", "idx"], "left")
    found = rows.groupBy("prot", "run").agg(F.min("idx").alias("seg_s"), F.max("idx").alias("seg_e"), F.avg("plddt").alias("m"), F.sum(F.coalesce("k", F.lit(0))).alias("degree"), F.count("*").alias("n"))
    sizes = fx.residues(spark, folder).groupBy("prot").agg(F.max("idx").alias("size"))
    kind = F.when((F.col("seg_s") <= 10) | (F.col("seg_e") > F.col("size") - 10), "terminal").when(F.col("m") < 50, "disordered").when(F.col("degree") / F.col("n") < 2, "isolated").otherwise("linker")
    return found.join(sizes, "prot").select("prot", "seg_s", "seg_e", kind.alias("kind"))


@query("select prot, idx from (select *, max(plddt) over (partition by prot order by idx rows between 10 preceding and 10 following) as top from fx_res) where plddt >= top - 0.1")
def w10_local_maxima(spark, folder):
    around = Window.partitionBy("prot").orderBy("idx").rowsBetween(-10, 10)
    return fx.residues(spark, folder).withColumn("top", F.max("plddt").over(around)).where("plddt >= top - 0.1").select("prot", "idx")


@query(
    """select prot, seg_s, seg_e, n, (select max(dom) from mem m where m.prot = g.prot and m.idx = g.seg_s - 1 and m.plddt >= 60) as left_dom, (select min(dom) from mem m where m.prot = g.prot and m.idx = g.seg_e + 1 and m.plddt >= 60) as right_dom
from (select prot, min(idx) as seg_s, max(idx) as seg_e, count(*) as n from (select *, sum(f) over (partition by prot order by idx) as run from (select prot, idx, case when idx - lag(idx) over (partition by prot order by idx) <= 1 then 0 else 1 end as f from mem where plddt < 60)) group by prot, run) g""",
    _E,
)
def w09_linkers(spark, folder):
    members = _members(spark, folder)
    free = runs(members.where("plddt < 60"), ["prot"], "idx", 1)
    kept = members.where("plddt >= 60")
    left = kept.select("prot", (F.col("idx") + 1).alias("seg_s"), F.col("dom").alias("left_dom"))
    right = kept.select("prot", (F.col("idx") - 1).alias("seg_e"), F.col("dom").alias("right_dom"))
    return free.join(left, ["prot", "seg_s"], "left").join(right, ["prot", "seg_e"], "left").select("prot", "seg_s", "seg_e", "n", "left_dom", "right_dom")


@query("select prot, dom, round(avg(plddt), 6) as mean_plddt, round(0.7 * (1 - avg(plddt) / 100) + 0.3 * avg(case when plddt < 50 then 1 else 0 end), 6) as flexibility from mem group by prot, dom", _E)
def p31_flexibility(spark, folder):
    """A14 and P31; residues under 50 stand for the flexible ones."""
    soft = F.avg((F.col("plddt") < 50).cast("double"))
    rows = _members(spark, folder).groupBy("prot", "dom")
    return rows.agg(F.round(F.avg("plddt"), 6).alias("mean_plddt"), F.round(0.7 * (1 - F.avg("plddt") / 100) + 0.3 * soft, 6).alias("flexibility"))


@query(
    """select s.prot, s.dom, round(2 * ln(1 + f.internal / s.size) + 2 * ln(1 + case when f.external > 0 then f.internal / f.external else 0 end) + (least(2.0::double, greatest(0.0::double, 2.5 * power(s.size, 0.4::double) / s.rg)) - 1) + 0.5 * (s.mean_plddt - 50) / 50 + 0.1 * ln(s.size), 5) as score
from shape s join fig f on f.prot = s.prot and f.dom = s.dom where s.rg > 0""",
    _E,
)
def p36_domain_score(spark, folder):
    rows = st.compactness(fx.residues(spark, folder), _members(spark, folder)).where("rg > 0").drop("size").join(_figures(spark, folder), ["prot", "dom"])
    n = F.col("size")
    ratio = F.when(F.col("external") > 0, F.col("internal") / F.when(F.col("external") > 0, F.col("external"))).otherwise(0.0)
    compact = F.least(F.lit(2.0), F.greatest(F.lit(0.0), 2.5 * F.pow(n, F.lit(0.4)) / F.col("rg"))) - 1
    score = 2 * F.log1p(F.col("internal") / n) + 2 * F.log1p(ratio) + compact + 0.5 * (F.col("mean_plddt") - 50) / 50 + 0.1 * F.ln(n.cast("double"))
    return rows.select("prot", "dom", F.round(score, 5).alias("score"))


@query("select prot, dom, round(avg(plddt), 6) as best from (select *, row_number() over (partition by prot order by m desc, dom) as k from (select *, row_number() over (partition by prot order by dom) as tried from (select prot, dom, avg(plddt) as m, avg(plddt) as plddt from mem group by prot, dom)) where tried <= 20) where k = 1 group by prot, dom", _E)
def a15_best_model(spark, folder):
    """The best of the first twenty models."""
    means = _members(spark, folder).groupBy("prot", "dom").agg(F.avg("plddt").alias("m"))
    means = means.withColumn("tried", F.row_number().over(Window.partitionBy("prot").orderBy("dom"))).where("tried <= 20")
    best = means.groupBy("prot").agg(F.max(F.struct("m", (-F.col("dom")).alias("minus"))).alias("b"))
    return best.select("prot", (-F.col("b.minus")).alias("dom"), F.round("b.m", 6).alias("best"))


@query("select prot, count(*) as crossings from (select prot, dom, lag(dom) over (partition by prot order by idx) as before from (select prot, idx, cast(floor(plddt / 20) as integer) as dom from fx_res)) where before is not null and dom <> before group by prot")
def a37_chain_crossings(spark, folder):
    by = Window.partitionBy("prot").orderBy("idx")
    rows = fx.residues(spark, folder).select("prot", "idx", F.floor(F.col("plddt") / 20).alias("dom"))
    return rows.withColumn("before", F.lag("dom").over(by)).where("before is not null and dom <> before").groupBy("prot").agg(F.count("*").alias("crossings"))


@query("select r.prot, r.idx, round(r.x, 3) as x, round(r.y, 3) as y, round(r.z, 3) as z, round(r.plddt, 2) as plddt from fx_res r")
def s21_atom_lines(spark, folder):
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C", "idx", "idx", "x", "y", "z", "plddt")
    rows = atoms(fx.residues(spark, folder).select("prot", line.alias("line")))
    return rows.select("prot", F.col("resnum").alias("idx"), "x", "y", "z", "plddt")


@query("select prot, idx, case when plddt > 70 then 'H' when plddt > 50 then 'E' else '-' end as ss, cast(idx % 100 as integer) as accessibility from fx_res")
def s23_secondary_structure_lines(spark, folder):
    code = F.expr("case when plddt > 70 then 'H' when plddt > 50 then 'E' else ' ' end")
    line = F.format_string("%5d%5d A A  %s                 %4d  %6d,%4.1f", "idx", "idx", code, F.col("idx") % 100, F.lit(-2), F.lit(-1.5))
    return secondary_structure(fx.residues(spark, folder).select("prot", line.alias("line"))).select("prot", F.col("resnum").alias("idx"), "ss", "accessibility")


@query("select prot, dom, round(avg(case when plddt > 70 then 1 else 0 end), 6) as helix, round(avg(case when plddt > 50 and plddt <= 70 then 1 else 0 end), 6) as strand from mem group by prot, dom", _E)
def x44_structure_content(spark, folder):
    share = lambda c: F.round(F.avg(F.expr(c).cast("double")), 6)
    return _members(spark, folder).groupBy("prot", "dom").agg(share("plddt > 70").alias("helix"), share("plddt > 50 and plddt <= 70").alias("strand"))


@query("select a.prot, cast(a.idx as integer) as i, cast(b.idx as integer) as j, cast(abs(a.idx - b.idx) as double) as pae from fx_res a join fx_res b on b.prot = a.prot")
def s22_aligned_errors(spark, folder):
    """One line for each row of a protein's matrix."""
    residues = fx.residues(spark, folder).select("prot", F.col("idx").alias("at"))
    sizes = residues.groupBy("prot").agg(F.max("at").alias("n"))
    row = F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: F.abs(F.col("at") - j).cast("double"))
    lines = residues.join(sizes, "prot").select("prot", "at", F.to_json(F.struct(F.array(row).alias("predicted_aligned_error"))).alias("line"))
    return aligned_errors(lines).select("prot", F.col("at").alias("i"), "j", "pae")


@query()
def x03_communities(spark, folder):
    return st.communities(_edges(spark, folder))


@query(
    "select prot, idx, dom from grow where round = (select max(round) from grow)",
    f"""{_E}, both_ways as (select prot, i as u, j as idx, w from e union all select prot, j, i, w from e),
grow as (select 0 as round, true as more, prot, idx, idx as dom from (select *, max(plddt) over (partition by prot order by idx rows between 10 preceding and 10 following) as top from fx_res) where plddt >= top - 0.1
  union all select * from (with own as (select * from grow), joins as (select prot, u as idx, dom from (select prot, u, dom, row_number() over (partition by prot, u order by pull desc, dom) as k from (
      select b.prot, b.u, m.dom, round(sum(b.w), 9) as pull from both_ways b join own m on m.prot = b.prot and m.idx = b.idx where not exists (select 1 from own o where o.prot = b.prot and o.idx = b.u) group by all having round(sum(b.w), 9) >= 0.05)) where k = 1)
    select round + 1, (select count(*) from joins) > 0, prot, idx, dom from own where more union all select (select max(round) from own) + 1, true, prot, idx, dom from joins))""",
)
def x24_grown_domains(spark, folder):
    seeds = w10_local_maxima(spark, folder).withColumn("dom", F.col("idx"))
    return st.grown(_edges(spark, folder), seeds, 0.05)


@query(
    "select prot, idx, dom from means where round = (select max(round) from means)",
    f"""{_E}, start as (select prot, dom, round(avg(x), 6) as sx, round(avg(y), 6) as sy, round(avg(z), 6) as sz from mem group by prot, dom),
means as (select 0 as round, prot, idx, dom from (select r.prot, r.idx, s.dom, row_number() over (partition by r.prot, r.idx order by (r.x - s.sx) * (r.x - s.sx) + (r.y - s.sy) * (r.y - s.sy) + (r.z - s.sz) * (r.z - s.sz), s.dom) as k from fx_res r join start s on s.prot = r.prot) where k = 1
  union all select * from (with own as (select * from means), centre as (select r.prot, o.dom, round(avg(r.x), 6) as sx, round(avg(r.y), 6) as sy, round(avg(r.z), 6) as sz from fx_res r join own o using (prot, idx) group by r.prot, o.dom)
    select (select max(round) from own) + 1, prot, idx, dom from (select r.prot, r.idx, s.dom, row_number() over (partition by r.prot, r.idx order by (r.x - s.sx) * (r.x - s.sx) + (r.y - s.sy) * (r.y - s.sy) + (r.z - s.sz) * (r.z - s.sz), s.dom) as k
      from fx_res r join centre s on s.prot = r.prot) where k = 1 and (select max(round) from own) < 60))""",
)
def x29_kmeans(spark, folder):
    return st.kmeans(fx.residues(spark, folder), _seeds(spark, folder))


@query("select r.prot, r.idx, round(r.x, 3) as x, round(r.y, 3) as y, round(r.z, 3) as z, round(r.plddt, 2) as plddt from fx_res r")
def s21_table_atoms(spark, folder):
    """Coordinates in the form of mmCIF: columns named in front, other atoms and other positions between."""
    columns = ("group_PDB", "id", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "auth_seq_id", "auth_asym_id", "pdbx_PDB_model_num")
    residues = fx.residues(spark, folder)
    head = residues.select("prot").distinct().select("prot", F.posexplode(F.array(*[F.lit(f"_atom_site.{c}") for c in columns])).alias("place", "line"))
    form = "ATOM %d {} {} ALA A %d %.3f %.3f %.3f %.2f %d A {}"
    row = lambda atom, alt, model: F.format_string(form.format(atom, alt, model), "idx", "idx", "x", "y", "z", "plddt", "idx")
    lines = residues.select("prot", (F.col("idx") + 100).alias("place"), F.explode(F.array(row("CA", ".", 1), row("CB", ".", 1), row("CA", "B", 1), row("CA", ".", 2))).alias("line"))
    rows = table_atoms(head.unionByName(lines), "prot", "place")
    return rows.select("prot", F.col("resnum").alias("idx"), "x", "y", "z", "plddt")


@query(
    """select prot, donor, acceptor, energy from (select *, row_number() over (partition by prot, least(donor, acceptor), greatest(donor, acceptor) order by donor, field) as k from (
select prot, idx as donor, idx - 2 as acceptor, 1 as field, -1.5::double as energy from fx_res union all select prot, idx, idx + cast(idx % 3 as integer), 2, round(-(idx % 5) / 10.0::double, 1) from fx_res where idx % 3 > 0 and idx % 5 > 0)) where k = 1"""
)
def s23_bond_pairs(spark, folder):
    """Both bonds of a line, each two residues once."""
    line = F.format_string("%5d%5d A A  H                 %4d %6d,%4.1f%6d,%4.1f", "idx", "idx", F.lit(0), F.lit(-2), F.lit(-1.5), (F.col("idx") % 3).cast("int"), -(F.col("idx") % 5) / 10.0)
    return hydrogen_bonds(secondary_structure(fx.residues(spark, folder).select("prot", line.alias("line"))), "prot")


@query(
    """select prot, start, "end", side, seg_s, seg_e from (select s.prot, s.start, s."end", 'left' as side, s.parent_start as seg_s, s.start - 1 as seg_e from par s union all select s.prot, s.start, s."end", 'right', s."end" + 1, s.parent_end from par s) where seg_s <= seg_e""",
    f"""{_BR}, par as (select prot, a as start, b as "end", start as parent_start, e2 as parent_end from (select i.prot, i.start as a, i."end" as b, o.start, o."end" as e2, row_number() over (partition by i.prot, i.start, i."end" order by o."end" - o.start, o.start, o."end") as k
from (select distinct prot, start, "end" from br) i join (select distinct prot, start, "end" from br) o on o.prot = i.prot and o.start <= i.start and i."end" <= o."end" and (o.start < i.start or i."end" < o."end")) where k = 1)""",
)
def x15_flanks(spark, folder):
    """What a bridge leaves of the one around it, on either side."""
    rows = st.smallest_container(_bridges(spark, folder)).where("parent_start is not null")
    side = lambda name, s, e: F.struct(F.lit(name).alias("side"), s.alias("seg_s"), e.alias("seg_e"))
    sides = F.explode(F.array(side("left", F.col("parent_start"), F.col("start") - 1), side("right", F.col("end") + 1, F.col("parent_end"))))
    return rows.select("prot", "start", "end", sides.alias("f")).select("prot", "start", "end", "f.*").where("seg_s <= seg_e")


@query(
    """select prot, dom, idx, format('ATOM  {:5d}  CA  ALA {}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00{:6.2f}           C', idx, chr(cast(65 + dom % 26 as integer)), idx, x, y, z, plddt) as line from mem
where idx between (select min(idx) from mem m where m.prot = mem.prot and m.dom = mem.dom and m.plddt >= 40) and (select max(idx) from mem m where m.prot = mem.prot and m.dom = mem.dom and m.plddt >= 40)""",
    _E,
)
def x43_chopped_lines(spark, folder):
    """Coordinate lines of each domain from its first to its last confident residue, under a chain letter of its own."""
    members = _members(spark, folder)
    span = members.where("plddt >= 40").groupBy("prot", "dom").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    rows = members.join(span, ["prot", "dom"]).where("idx between a and b")
    chain = F.char((F.lit(65) + F.col("dom") % 26).cast("bigint"))
    line = F.format_string("ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C", "idx", chain, "idx", "x", "y", "z", "plddt")
    return rows.select("prot", "dom", "idx", line.alias("line"))
