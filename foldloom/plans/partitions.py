"""Domains merged, split, nested and chosen."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldloom.functions import intervals as iv
from foldloom.operators import evaluation as ev
from foldloom.operators import partition as pt
from foldloom.operators import structure as st
from foldloom.operators.greedy import greedy_picks, used_once
from foldloom.operators.intervals import overlap_join
from foldloom.operators.islands import core_segments, merged, runs, spaced, without_intrusions
from foldloom.operators.sequences import non_redundant, sequence_clusters, superposed
from foldloom.plans.registry import Plans, greedy
from foldloom.plans.structure import _BR, _E, REACH, SIGMA, _bridges, _edges, _figures, _members
from foldloom.scratch import Pile, cut
from foldloom.sources import fixtures as fx
from foldloom.sources.lines import by_delimiter, by_pattern
from foldloom.sources.tables import table

query = Plans()
QUERIES, ORACLES = query.queries, query.oracles


def _density(spark, folder):
    """Contacts between two domains by the size of the smaller."""
    m = _members(spark, folder).select("prot", "idx", "dom")
    sizes = m.groupBy("prot", "dom").agg(F.count("*").alias("n"))
    ends = _edges(spark, folder).join(m.withColumnsRenamed({"idx": "i", "dom": "da"}), ["prot", "i"]).join(m.withColumnsRenamed({"idx": "j", "dom": "db"}), ["prot", "j"])
    sums = ends.where("da <> db").groupBy("prot", F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")).agg(F.sum("w").alias("w"))
    rows = sums.join(sizes.withColumnsRenamed({"dom": "a", "n": "na"}), ["prot", "a"]).join(sizes.withColumnsRenamed({"dom": "b", "n": "nb"}), ["prot", "b"])
    return rows.select("prot", "a", "b", (F.col("w") / F.least("na", "nb")).alias("density"))


_DEN = f"""{_E}, den as (select q.prot, q.a, q.b, q.w / least(x.n, y.n) as density from (select prot, least(di, dj) as a, greatest(di, dj) as b, sum(w) as w from ee where di <> dj group by 1, 2, 3) q
join (select prot, dom, count(*) as n from mem group by prot, dom) x on x.prot = q.prot and x.dom = q.a join (select prot, dom, count(*) as n from mem group by prot, dom) y on y.prot = q.prot and y.dom = q.b)"""


@query("select prot, a, b, round(density, 6) as density from den", _DEN)
def x08_contacts_between_domains(spark, folder):
    return _density(spark, folder).withColumn("density", F.round("density", 6))


@query(
    """select n.prot, n.dom, coalesce(min(p.dom), n.dom) as head from (select distinct prot, dom from mem) n left join (select prot, unnest(picks).dom as dom from picked) p
on p.prot = n.prot and (p.dom = n.dom or (p.dom < n.dom and exists (select 1 from den d where d.prot = n.prot and d.a = p.dom and d.b = n.dom and d.density > 0.05) and not exists (select 1 from (select prot, unnest(picks).dom as dom from picked) q where q.prot = n.prot and q.dom = n.dom))) group by n.prot, n.dom""",
    f"""{_DEN}, per as (select m.prot, list([{{'dom': m.dom}}] order by m.dom) as items, any_value(coalesce(c.cf, [])) as cf from (select distinct prot, dom from mem) m left join (select prot, list(concat(a, '/', b)) as cf from den where density > 0.05 group by prot) c using (prot) group by m.prot),
picked as (select prot, list_reduce(items, lambda acc, x: case when len(list_filter(acc, lambda y: list_contains(cf, concat(y.dom, '/', x[1].dom)))) > 0 then acc else list_concat(acc, x) end) as picks from per)""",
)
def x08_merged_domains(spark, folder):
    """Domains in order of their start take those behind them that are in close contact."""
    nodes = _members(spark, folder).select("prot", "dom").distinct()
    return greedy_picks(nodes, _density(spark, folder).where("density > 0.05"), "prot", "dom", "dom")


@query(
    """select prot, min(dom) as dom, max(dom) as last_dom, count(*) as n from (select *, sum(f) over (partition by prot order by dom) as run from (select g.prot, g.dom, case when d.density > 0.03 and lag(g.low) over (partition by g.prot order by g.dom) and g.low then 0 else 1 end as f
from (select prot, dom, external > 0 and internal / external < 4 as low from fig) g left join den d on d.prot = g.prot and d.a = g.dom - 1 and d.b = g.dom)) group by prot, run""",
    _DEN,
)
def x09_merged_repeats(spark, folder):
    """Neighbouring domains with low contact ratios and contacts between them."""
    by = Window.partitionBy("prot").orderBy("dom")
    low = (F.col("external") > 0) & (F.col("ratio") < 4)
    rows = _figures(spark, folder).withColumn("low", low).drop("density")
    near = _density(spark, folder).where("b = a + 1").select("prot", F.col("b").alias("dom"), "density")
    joins = (F.col("density") > 0.03) & F.lag("low").over(by) & F.col("low")
    rows = rows.join(near, ["prot", "dom"], "left").withColumn("f", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("f").over(by))
    return rows.groupBy("prot", "run").agg(F.min("dom").alias("dom"), F.max("dom").alias("last_dom"), F.count("*").alias("n")).drop("run")


@query(
    """select prot, start, "end", cast(max(depth) as integer) as level from up group by all""",
    f"""{_BR}, sp as (select distinct prot, start, "end" from br),
par as (select prot, a as start, b as "end", start as ps, e2 as pe from (select i.prot, i.start as a, i."end" as b, o.start, o."end" as e2, row_number() over (partition by i.prot, i.start, i."end" order by o."end" - o.start, o.start, o."end") as k
from sp i join sp o on o.prot = i.prot and o.start <= i.start and i."end" <= o."end" and (o.start < i.start or i."end" < o."end")) where k = 1),
up as (select s.prot, s.start, s."end", s.start as ts, s."end" as te, 0 as depth from sp s union all select u.prot, u.start, u."end", p.ps, p.pe, u.depth + 1 from up u join par p on p.prot = u.prot and p.start = u.ts and p."end" = u.te)""",
)
def x15_nesting_levels(spark, folder):
    """How many bridges contain a bridge, each the smallest container of the one before."""
    parents = cut(st.smallest_container(_bridges(spark, folder)), "parents")
    above = parents.where("parent_start is not null").select("prot", F.col("start").alias("ts"), F.col("end").alias("te"), F.col("parent_start").alias("ns"), F.col("parent_end").alias("ne"))
    at = parents.select("prot", "start", "end", F.col("start").alias("ts"), F.col("end").alias("te"))
    pile, level = Pile(at.select("prot", "start", "end", F.lit(0).alias("level")), "levels"), 0
    while not at.isEmpty():
        pile.add(at.select("prot", "start", "end", F.lit(level).alias("level")))
        level += 1
        at = cut(at.join(above, ["prot", "ts", "te"]).select("prot", "start", "end", F.col("ns").alias("ts"), F.col("ne").alias("te")), "levels")
    return pile.rows().groupBy("prot", "start", "end").agg(F.max("level").alias("level"))


@query(
    """select prot, min(start) as seg_s, max("end") as seg_e, count(*) as n from (select *, sum(f) over (partition by prot order by start, "end" rows between unbounded preceding and current row) as run from (select prot, start, "end",
case when start - max("end") over (partition by prot order by start, "end" rows between unbounded preceding and 1 preceding) <= 0 then 0 else 1 end as f from br)) group by prot, run""",
    _BR,
)
def x14_merged_bridges(spark, folder):
    return merged(_bridges(spark, folder), ["prot"], "start", "end", 0)


@query(
    """select prot, c, round(sum(case when i < c and j >= c then w else 0 end) / sum(w), 6) as crossing, round(sum(case when j < c then w else 0 end), 6) as before, round(sum(case when i >= c then w else 0 end), 6) as after
from e join (select distinct prot, dom * 25 + 1 as c from mem where dom > 0) using (prot) group by prot, c""",
    _E,
)
def x19_candidate_cuts(spark, folder):
    """Sums of weights in front of each cut, from running sums by either end of the contacts."""
    cuts = _members(spark, folder).where("dom > 0").select("prot", (F.col("dom") * 25 + 1).alias("c")).distinct()
    edges = _edges(spark, folder)
    zero = F.lit(0.0)
    at = edges.select("prot", F.col("i").alias("c"), F.col("w").alias("wi"), zero.alias("wj")).unionAll(edges.select("prot", "j", zero, "w"))
    at = at.groupBy("prot", "c").agg(F.sum("wi").alias("wi"), F.sum("wj").alias("wj")).join(cuts.withColumn("is_cut", F.lit(True)), ["prot", "c"], "full")
    before = Window.partitionBy("prot").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    rows = at.withColumns({"begun": F.coalesce(F.sum("wi").over(before), zero), "ended": F.coalesce(F.sum("wj").over(before), zero), "all": F.sum("wi").over(Window.partitionBy("prot"))})
    rows = rows.where("is_cut and all is not null")
    return rows.select("prot", "c", F.round((F.col("begun") - F.col("ended")) / F.col("all"), 6).alias("crossing"), F.round("ended", 6).alias("before"), F.round(F.col("all") - F.col("begun"), 6).alias("after"))


@query(
    """select prot, dom, min(idx) filter (k >= 2) as first, max(idx) filter (k >= 2) as last from (select m.prot, m.dom, m.idx, coalesce(g.k, 0) as k from mem m
left join (select prot, idx, count(*) as k from (select prot, i as idx from ee where di = dj and j - i >= 10 union all select prot, j from ee where di = dj and j - i >= 10) group by all) g on g.prot = m.prot and g.idx = m.idx) group by prot, dom""",
    _E,
)
def x27_trimmed_ends(spark, folder):
    """Domains from the first to the last residue with at least two long-range contacts inside."""
    m = _members(spark, folder).select("prot", "idx", "dom")
    far = _edges(spark, folder).where("j - i >= 10").join(m.withColumnsRenamed({"idx": "i", "dom": "da"}), ["prot", "i"]).join(m.withColumnsRenamed({"idx": "j", "dom": "db"}), ["prot", "j"]).where("da = db")
    degree = far.select("prot", F.explode(F.array("i", "j")).alias("idx")).groupBy("prot", "idx").agg(F.count("*").alias("k"))
    good = F.when(F.col("k") >= 2, F.col("idx"))
    return m.join(degree, ["prot", "idx"], "left").groupBy("prot", "dom").agg(F.min(good).alias("first"), F.max(good).alias("last"))


@query(
    """select prot, method, n, total from (select *, row_number() over (partition by prot order by total desc, method) as k from (select prot, method, count(*) as n, cast(sum(e - s + 1) as bigint) as total from fx_pred group by prot, method)) where k = 1"""
)
def x22_best_method(spark, folder):
    rows = fx.predictions(spark, folder).groupBy("prot", "method").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s") + 1).alias("total"))
    first = Window.partitionBy("prot").orderBy(F.desc("total"), "method")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


@query(
    """select prot, min(idx) as seg_s, max(idx) as seg_e, count(*) as n from (select *, sum(f) over (partition by prot order by idx) as run from (select prot, idx, case when idx - lag(idx) over (partition by prot order by idx) <= 20 then 0 else 1 end as f from fx_res where plddt < 60 and plddt >= 20)) group by prot, run having count(*) >= 10"""
)
def x06_rescued_clusters(spark, folder):
    """Stretches of unordered residues of fair confidence that are long enough to be domains."""
    return runs(fx.residues(spark, folder).where("plddt < 60 and plddt >= 20"), ["prot"], "idx", 20).where("n >= 10")


@query(
    """select prot, method, min(s) as seg_s, max(e) as seg_e, count(*) as n from (select *, sum(f) over (partition by prot, method order by s, e rows between unbounded preceding and current row) as run from (select prot, method, s, e,
case when s - max(e) over (partition by prot, method order by s, e rows between unbounded preceding and 1 preceding) <= 20 then 0 else 1 end as f from fx_pred)) group by prot, method, run having max(e) - min(s) + 1 >= 60"""
)
def x31_stitched_segments(spark, folder):
    return merged(fx.predictions(spark, folder), ["prot", "method"], "s", "e", 20).where("seg_e - seg_s + 1 >= 60")


@query(
    """select prot, round(1000 * q - 0.5 * crossings - 5 * k, 4) as score from (select d.prot, sum((coalesce(a.a, 0) - d.k * d.k / (4.0::double * t.m)) / t.m) as q, count(*) as k from (select m.prot, m.dom, cast(sum(g.k) as double) as k from mem m join (select prot, idx, count(*) as k from (select prot, i as idx from e union all select prot, j from e) group by all) g on g.prot = m.prot and g.idx = m.idx group by m.prot, m.dom) d
join (select prot, count(*) as m from e group by prot) t on t.prot = d.prot left join (select prot, di as dom, count(*) as a from ee where di = dj group by prot, di) a on a.prot = d.prot and a.dom = d.dom group by d.prot)
join (select prot, count(*) filter (dom <> before) as crossings from (select prot, dom, lag(dom) over (partition by prot order by idx) as before from mem) group by prot) using (prot)""",
    _E,
)
def a38_partition_score(spark, folder):
    """A38 and X30: modularity in thousandths less chain crossings and number of domains."""
    by = Window.partitionBy("prot").orderBy("idx")
    members = _members(spark, folder)
    crossed = members.withColumn("before", F.lag("dom").over(by)).groupBy("prot").agg(F.count_if(F.col("dom") != F.col("before")).alias("crossings"), F.countDistinct("dom").alias("k"))
    rows = st.modularity(_edges(spark, folder), members).join(crossed, "prot")
    return rows.select("prot", F.round(1000 * F.col("q") - 0.5 * F.col("crossings") - 5 * F.col("k"), 4).alias("score"))


@query(
    f"""select prot, k.idx as idx from ({greedy("peak", ["prot"], "{'idx': idx}", "round(plddt, 6) desc, idx", "abs(y.idx - x[1].idx) <= 9")})""",
    "peak as (select prot, idx, plddt from (select *, max(plddt) over (partition by prot order by idx rows between 10 preceding and 10 following) as top from fx_res) where plddt >= top - 0.1)",
)
def x23_spaced_seeds(spark, folder):
    """Peaks of confidence, the highest first, each at least ten residues from those before."""
    return st.seeds_by(fx.residues(spark, folder), "plddt_peaks")


@query()
def x17_fiedler_vectors(spark, folder):
    return pt.fiedler(_edges(spark, folder)).withColumn("value", F.round("value", 6))


@query()
def w11_split_candidates(spark, folder):
    """W11: candidates from the vectors, each at least 30 residues behind the one before."""
    return spaced(pt.split_candidates(pt.fiedler(_edges(spark, folder))), ["prot"], "idx", 30)


@query()
def x20_best_segments(spark, folder):
    """X20 and X21."""
    lengths = fx.residues(spark, folder).groupBy("prot").agg(F.max("idx").alias("n"))
    return pt.best_segments(_edges(spark, folder), lengths, [0.0, 0.05, 0.2], 10)


@query(
    f"""select prot, k.t as t, k.p as p, round(k.iou, 6) as similarity from ({greedy("near", ["prot"], "{'t': t, 'p': p, 'iou': iou}", "iou desc, t, p", "y.t = x[1].t or y.p = x[1].p")})""",
    """bt as (select distinct prot, unnest([s, e]) as b from fx_pred where method = 'purchase'), bp as (select distinct prot, unnest([s, e]) as b from fx_pred where method = 'signup'),
near as (select t.prot, t.b as t, p.b as p, 1 - abs(t.b - p.b) / 10.0::double as iou from bt t join bp p on p.prot = t.prot and abs(t.b - p.b) <= 9)""",
)
def x38_matched_boundaries(spark, folder):
    """Boundaries of two methods within ten residues, matched one to one by similarity."""
    side = lambda m: fx.predictions(spark, folder).where(F.col("method") == m).select("prot", F.explode(F.array("s", "e")).alias("b")).distinct()
    a = side("purchase").select("prot", F.col("b").alias("t"), (F.col("b") - 9).alias("lo"), (F.col("b") + 9).alias("hi"))
    b = side("signup").select("prot", F.col("b").alias("p"), F.col("b").alias("p_end"))
    pairs = overlap_join(a, b, "prot", "lo", "hi", "p", "p_end").select("prot", "t", "p", (1 - F.abs(F.col("t") - F.col("p")) / 10).alias("iou"))
    return ev.matched(pairs).select("prot", "t", "p", F.round("iou", 6).alias("similarity"))


@query(
    "select prot, k, overlap from (select *, row_number() over (partition by prot order by overlap, k) as place from (select prot, k, round(sum(area), 6) as overlap from area group by prot, k)) where place = 1",
    f"""{_E}, view as (select cast(k as integer) as k, k * pi() * (3 - sqrt(5.0::double)) as th, acos(1 - 2 * (k + 0.5) / 1000.0::double) as ph from range(1000) u(k)),
box as (select prot, k, dom, min(u) as u1, max(u) as u2, min(w) as w1, max(w) as w2 from (select prot, dom, k, -sin(th) * x + cos(th) * y as u, cos(th) * cos(ph) * x + sin(th) * cos(ph) * y - sin(ph) * z as w from mem, view) group by all),
area as (select a.prot, a.k, greatest(0, least(a.u2, b.u2) - greatest(a.u1, b.u1)) * greatest(0, least(a.w2, b.w2) - greatest(a.w1, b.w1)) as area from box a join box b on b.prot = a.prot and b.k = a.k and a.dom < b.dom
  union all select distinct prot, k, 0 from box)""",
)
def x42_best_rotation(spark, folder):
    """X42 and P37."""
    return pt.best_rotation(fx.residues(spark, folder), _members(spark, folder), 1000)


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where props is not null")
def s30_landed_json(spark, folder):
    return table(spark, folder, "events").where("props is not null").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select prot, to_json({'prot': prot, 'method': method, 'n': count(*), 'first': min(s), 'last': max(e)})::varchar as record from fx_pred group by prot, method")
def k07_json_records(spark, folder):
    rows = fx.predictions(spark, folder).groupBy("prot", "method").agg(F.count("*").alias("n"), F.min("s").alias("first"), F.max("e").alias("last"))
    return rows.select("prot", F.to_json(F.struct("prot", "method", "n", "first", "last")).alias("record"))


@query(
    """select prot, concat('select #1:', string_agg(concat(seg_s, '-', seg_e), ',' order by seg_s), '; color red sel') as script from (select prot, min(idx) as seg_s, max(idx) as seg_e from (select *, sum(f) over (partition by prot order by idx) as run from (select prot, idx,
case when idx - lag(idx) over (partition by prot order by idx) <= 3 then 0 else 1 end as f from fx_res where plddt >= 60)) group by prot, run) group by prot"""
)
def k10_viewer_scripts(spark, folder):
    segs = runs(fx.residues(spark, folder).where("plddt >= 60"), ["prot"], "idx", 3)
    ordered = F.sort_array(F.collect_list(F.struct("seg_s", "seg_e")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws("-", x["seg_s"], x["seg_e"])), ",")
    return segs.groupBy("prot").agg(F.concat(F.lit("select #1:"), text, F.lit("; color red sel")).alias("script"))


@query(
    "select prot, a as node, min(b) as first from reach group by prot, a",
    f"""{_BR}, lk as (select distinct prot, start as a, "end" as b from br union select distinct prot, "end", start from br),
reach as (select distinct prot, a, a as b from lk union select r.prot, r.a, l.b from reach r join lk l on l.prot = r.prot and l.a = r.b)""",
)
def x01_bridged_components(spark, folder):
    return st.components(_bridges(spark, folder).select("prot", F.col("start").alias("a"), F.col("end").alias("b")), "prot", "a", "b")


@query(
    f"""select prot, k.s as s, k.e as e from ({greedy("(select distinct prot, s, e from fx_pred)", ["prot"], "{'s': s, 'e': e}", "s - e, s, e",
    "case when greatest(y.s, x[1].s) >= least(y.e, x[1].e) then 0 else (least(y.e, x[1].e) - greatest(y.s, x[1].s) + 1) / least(y.e - y.s + 1, x[1].e - x[1].s + 1) end >= 0.8")})"""
)
def x26_consolidated_ranges(spark, folder):
    """Predicted ranges, the longest first, without those that share four fifths of the shorter with one before."""
    rows = fx.predictions(spark, folder).select("prot", "s", "e").distinct().withColumn("node", F.struct("s", "e"))
    a = rows.select("prot", F.col("node").alias("a"), "s", "e")
    b = rows.select("prot", F.col("node").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    near = overlap_join(a, b, "prot", "s", "e", "s2", "e2", 64).where(iv.shorter_fraction("s", "e", "s2", "e2") >= 0.8).where("a < b").select("prot", "a", "b")
    picks = greedy_picks(rows.withColumn("rank", F.col("s") - F.col("e")), near, "prot", "node", "rank")
    return picks.where("node = head").select("prot", "node.s", "node.e")


@query(
    f"""select least(k.fa, k.fb) as fam_1, greatest(k.fa, k.fb) as fam_2, count(*) as n_common, round(sum(k.score), 4) as sum_score
from ({greedy("once", ["acc"], "{'ka': ka, 'kb': kb, 'fa': fam_a, 'fb': fam_b, 'score': score}", "ao, al, fam_a, a_s, a_e, bo, bl, fam_b, b_s, b_e", "y.ka = x[1].ka or y.ka = x[1].kb or y.kb = x[1].ka or y.kb = x[1].kb")}) group by 1, 2""",
    """once as (select a.acc, a.okey as ao, a.ln as al, a.fam as fam_a, a.s as a_s, a.e as a_e, b.okey as bo, b.ln as bl, b.fam as fam_b, b.s as b_s, b.e as b_e, min(exp(-a.evalue) * exp(-b.evalue)) as score,
  concat_ws('/', a.okey, a.ln, a.fam, a.s, a.e, b.fam) as ka, concat_ws('/', b.okey, b.ln, b.fam, b.s, b.e, a.fam) as kb
  from fx_region a join fx_region b on a.acc = b.acc and (a.okey, a.ln, a.fam, a.s, a.e) < (b.okey, b.ln, b.fam, b.s, b.e) and a.s <= b.e and b.s <= a.e
  and ((a.s + a.e > 2 * b.s and a.s + a.e < 2 * b.e) or (b.s + b.e > 2 * a.s and b.s + b.e < 2 * a.e)) where a.fam <> b.fam group by all)""",
)
def a05_family_pairs_once(spark, folder):
    """A05 with each region counted once for each partner family, in order of the regions.

    Two pairs can only use the same key if they join the same two families on the same protein. So regions are shuffled once, by
    protein; k is the place of a region in the order of its protein, and the pass runs over pairs of places.
    """
    score = F.exp(-F.col("evalue")).alias("w")
    small = " and ".join(f"{c} between 0 and 65535" for c in ("s", "e", "ln"))  # then the three are shuffled as one number
    near, far = F.expr(f"case when {small} then shiftleft(s, 32) | shiftleft(e, 16) | ln end"), F.expr(f"case when not coalesce({small}, false) then struct(s, e, ln) end")
    rows = fx.hits(spark, folder).where("acc is not null and fam is not null").select("acc", "okey", "fam", near.alias("near"), far.alias("far"), score).repartition("acc")
    part = lambda c, shift: F.coalesce(f"far.{c}", F.shiftright("near", shift).bitwiseAND(65535)).alias(c)
    rows = rows.select("acc", "okey", "fam", part("s", 32), part("e", 16), part("ln", 0), "w")
    region = [F.col(c).asc_nulls_last() for c in ("okey", "ln", "fam", "s", "e")]
    at = Window.partitionBy("acc").orderBy(*region, F.col("w").asc_nulls_last())  # of equal regions the first has the lowest score
    same = F.struct("okey", "ln", "fam", "s", "e")
    rows = rows.withColumns({"k": F.row_number().over(at), "again": same.eqNullSafe(F.lag(same).over(at))}).where("not again")
    a, b = (rows.select(F.col("acc").alias(f"acc_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("fam", "s", "e", "w", "k")]) for x in "ab")
    met = (F.col("acc_a") == F.col("acc_b")) & (F.col("s_a") <= F.col("e_b")) & (F.col("s_b") <= F.col("e_a")) & (F.col("k_a") < F.col("k_b")) & (F.col("fam_a") != F.col("fam_b"))
    pairs = a.join(b, met & iv.midpoint_inside("s_a", "e_a", "s_b", "e_b")).select(
        "acc_a", F.least("fam_a", "fam_b").alias("fam_1"), F.greatest("fam_a", "fam_b").alias("fam_2"), "k_a", "k_b", (F.col("w_a") * F.col("w_b")).alias("score")
    )
    kept = used_once(pairs, ["acc_a", "fam_1", "fam_2"], "k_a", "k_b", ["fam_1", "fam_2", "score"]).groupBy("fam_1", "fam_2")
    return kept.agg(F.count("*").alias("n_common"), F.round(F.sum("score"), 4).alias("sum_score"))


@query(
    """select x.prot, x.method_a, x.method_b, x.n_both, p.n + q.n - x.n_both as n_any from (select a.prot, a.method as method_a, b.method as method_b, count(*) as n_both from d a join d b on b.prot = a.prot and b.day = a.day and a.method < b.method group by all) x
join c p on p.prot = x.prot and p.method = x.method_a join c q on q.prot = x.prot and q.method = x.method_b""",
    "d as (select distinct prot, method, day from fx_pred), c as (select prot, method, count(*) as n from d group by all)",
)
def u05_set_sizes(spark, folder):
    """Days on which both of two methods, or either, predicted domains of a protein."""
    sets = fx.predictions(spark, folder).groupBy("prot", "method").agg(F.collect_set("day").alias("days"))
    a, b = sets.withColumnsRenamed({"method": "method_a", "days": "da"}), sets.withColumnsRenamed({"method": "method_b", "days": "db"})
    rows = a.join(b, "prot").where("method_a < method_b")
    n = lambda f: F.size(f("da", "db")).cast("bigint")
    return rows.select("prot", "method_a", "method_b", n(F.array_intersect).alias("n_both"), n(F.array_union).alias("n_any")).where("n_both > 0")


@query("select domain_id, round(cast(total as double) / (span_e - span_s + 1), 6) as coverage from (select domain_id, sum(cast(split_part(x, '-', 2) as bigint) - cast(split_part(x, '-', 1) as bigint) + 1) as total, min(cast(split_part(x, '-', 1) as bigint)) as span_s, max(cast(split_part(x, '-', 2) as bigint)) as span_e from (select *, unnest(string_split(chopping, '_')) as x from ted_domains where chopping is not null) where regexp_full_match(x, '[0-9]+-[0-9]+') group by domain_id)")
def p30_segment_coverage(spark, folder):
    rows = iv.with_spans(table(spark, folder, "ted_domains"), "chopping")
    return rows.select("domain_id", F.round(F.col("d_len") / (F.col("span_e") - F.col("span_s") + 1), 6).alias("coverage"))


@query("select domain_id, uniprot_acc as acc, coalesce(ted_suffix, '') as suffix, chopping, consensus_level as level from ted_domains where uniprot_acc is not null and chopping is not null and consensus_level is not null and cath_label is not null and not contains(chopping, chr(9)) and not contains(chopping, chr(10))")
def s03_domain_lines(spark, folder):
    """Tab-separated domain lines; those with fewer than five columns are left out."""
    whole = "uniprot_acc is not null and chopping is not null and consensus_level is not null and cath_label is not null and not contains(chopping, chr(9)) and not contains(chopping, chr(10))"
    line = F.expr(f"case when {whole} then concat(uniprot_acc, chr(9), coalesce(ted_suffix, ''), chr(9), chopping, chr(9), consensus_level, chr(9), cath_label) else concat(coalesce(uniprot_acc, ''), chr(9), 'cut off') end")
    rows = table(spark, folder, "ted_domains").select("domain_id", line.alias("line"))
    return by_delimiter(rows, dict.fromkeys(("acc", "suffix", "chopping", "level", "label"), "string"), comment=None).select("domain_id", "acc", "suffix", "chopping", "level")


@query("select s_suppkey as acc, s_nationkey as pdb, round(s_acctbal, 2) as score from supplier where s_acctbal > 25")
def s31_marked_up_hits(spark, folder):
    """Values out of marked-up hit lines, with the cut-off of the score."""
    line = F.expr("""concat('<hit acc="', s_suppkey, '"><pdb id="', s_nationkey, '"/><score>', cast(s_acctbal as decimal(12, 2)), '</score></hit>')""")
    rows = by_pattern(table(spark, folder, "supplier").select(line.alias("line")), r'acc="(\d+)".*id="(\d+)".*<score>(-?[\d.]+)</score>', {"acc": "bigint", "pdb": "int", "score": "double"})
    return rows.where("score > 25").select("acc", "pdb", F.round("score", 2).alias("score"))


@query("select o.o_orderkey, coalesce(s.s_name, 'none') as representative from orders o left join supplier s on s.s_suppkey = o.o_custkey")
def s33_representatives(spark, folder):
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("o_custkey"), "s_name")
    return table(spark, folder, "orders").join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("s_name", F.lit("none")).alias("representative"))


@query(
    """select prot, seg_s, seg_e from core union select s.prot, s.seg_s, s.seg_e from seg s where s.size >= 5 and exists (select 1 from core c where c.prot = s.prot and greatest(0, c.seg_s - s.seg_e, s.seg_s - c.seg_e) <= 50)""",
    """seg as (select prot, min(idx) as seg_s, max(idx) as seg_e, max(idx) - min(idx) + 1 as size from (select *, sum(f) over (partition by prot order by idx) as run from (select prot, idx, case when idx - lag(idx) over (partition by prot order by idx) <= 1 then 0 else 1 end as f from fx_res where plddt >= 60)) group by prot, run),
core as (select prot, seg_s, seg_e from (select *, row_number() over (partition by prot order by size desc, seg_s desc) as k from seg) where k = 1
  union select s.prot, s.seg_s, s.seg_e from seg s join core c on c.prot = s.prot and greatest(0, c.seg_s - s.seg_e, s.seg_s - c.seg_e) <= case when s.size < 10 then 5 else 3 end)""",
)
def x07_core_segments(spark, folder):
    segs = runs(fx.residues(spark, folder).where("plddt >= 60"), ["prot"], "idx", 1)
    return core_segments(segs, ["prot"], 3)


_LAB = """lab as (select prot, idx, cast(floor(plddt / 34) as integer) as dom from fx_res),
chg as (select *, case when dom = lag(dom) over (partition by prot order by idx) then 0 else 1 end as f from lab),
run as (select prot, idx, dom, sum(f) over (partition by prot order by idx) as r from chg),
sums as (select prot, r, min(dom) as own, count(*) as n from run group by prot, r),
side as (select *, lag(own) over (partition by prot order by r) as b, lead(own) over (partition by prot order by r) as a from sums)"""


@query("select x.prot, x.idx, case when s.n < 3 and s.a = s.b then s.b else s.own end as dom from run x join side s on s.prot = x.prot and s.r = x.r", _LAB)
def x10_without_intrusions(spark, folder):
    labels = fx.residues(spark, folder).select("prot", "idx", F.floor(F.col("plddt") / 34).cast("int").alias("dom"))
    return without_intrusions(labels, ["prot"], "idx", "dom", 3)


@query()
def x12_extended_domains(spark, folder):
    core = _members(spark, folder).where("plddt >= 60").select("prot", "idx", "dom")
    return st.extended(fx.residues(spark, folder), _edges(spark, folder), core, cutoff=20, least=2)


@query()
def x16_predicted_domains(spark, folder):
    return st.predicted_domains(fx.residues(spark, folder), REACH, SIGMA, cutoff=40, min_size=3, min_ratio=0.01)


@query("select prot, a as node, min(b) as first from reach group by prot, a", f"""{_DEN}, lk as (select prot, a, b from den where density > 0.02 union select prot, b, a from den where density > 0.02),
reach as (select distinct prot, a, a as b from lk union select r.prot, r.a, l.b from reach r join lk l on l.prot = r.prot and l.a = r.b)""")
def x25_transitively_merged(spark, folder):
    return st.components(_density(spark, folder).where("density > 0.02"), "prot", "a", "b")


@query()
def x40_non_redundant_rows(spark, folder):
    return non_redundant(fx.alignment(spark, folder), "family", "line_id", "aln")


@query()
def x41_sequence_clusters(spark, folder):
    rows = fx.alignment(spark, folder).select("line_id", F.regexp_replace("aln", "[.-]", "").alias("seq"))
    short = rows.where("length(seq) between 1 and 4").select("line_id", F.col("line_id").alias("representative"))  # no word of 5
    return sequence_clusters(rows, "line_id", "seq").unionByName(short)


@query()
def x43_superposed(spark, folder):
    """Each protein laid on the one before it, residue by residue."""
    a = fx.residues(spark, folder).select("prot", "idx", "x", "y", "z")
    b = a.select((F.col("prot") + 1).alias("prot"), "idx", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    rows = superposed(a.join(b, ["prot", "idx"]), ["prot"])
    return rows.select("prot", "n", F.round("rmsd", 5).alias("rmsd"))
