"""Predicted domains of one method against those of another."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.operators import evaluation as ev
from foldloom.plans.registry import Plans, greedy
from foldloom.sources import fixtures as fx
from foldloom.sources.lines import truth_lines

query = Plans()
QUERIES, ORACLES = query.queries, query.oracles

TRUE, PRED = "purchase", "signup"

_P = f"""tr as (select prot, event_id as dom, s, e from fx_pred where method = '{TRUE}'), pr as (select prot, event_id as dom, s, e from fx_pred where method = '{PRED}'),
io as (select t.prot, t.dom as t, p.dom as p, (least(t.e, p.e) - greatest(t.s, p.s) + 1) / ((t.e - t.s + 1) + (p.e - p.s + 1) - (least(t.e, p.e) - greatest(t.s, p.s) + 1)) as iou, t.e - t.s + 1 as len
  from tr t join pr p on p.prot = t.prot and t.s <= p.e and p.s <= t.e)"""


def _domains(spark, folder, method):
    return fx.predictions(spark, folder).where(F.col("method") == method).select("prot", F.col("event_id").alias("dom"), "s", "e")


def _sides(spark, folder):
    return _domains(spark, folder, TRUE), _domains(spark, folder, PRED)


def _pairs(spark, folder):
    return ev.iou_pairs(*_sides(spark, folder))


@query("select prot, t, p, round(iou, 6) as iou from io", _P)
def a26_iou(spark, folder):
    """A26 and J26."""
    return _pairs(spark, folder).select("prot", "t", "p", F.round("iou", 6).alias("iou"))


@query(
    """select a.prot, a.t, a.p, round(a.iou, 6) as iou from (select *, row_number() over (partition by prot, t order by iou desc, t, p) as k from io) a
join (select *, row_number() over (partition by prot, p order by iou desc, t, p) as k from io) b on b.prot = a.prot and b.t = a.t and b.p = a.p and a.k = 1 and b.k = 1""",
    _P,
)
def x37_mutually_best(spark, folder):
    rank = F.struct("iou", (-F.col("t")).alias("mt"), (-F.col("p")).alias("mp"))
    pairs = _pairs(spark, folder)
    best = lambda side, name: pairs.groupBy("prot", side).agg(F.max(rank).alias(name))
    rows = pairs.join(best("t", "bt"), ["prot", "t"]).join(best("p", "bp"), ["prot", "p"]).where((F.col("bt") == rank) & (F.col("bp") == rank))
    return rows.select("prot", "t", "p", F.round("iou", 6).alias("iou"))


_MATCH = f"""{_P}, mt as (select prot, k.t as t, k.p as p, k.iou as iou from ({greedy("io", ["prot"], "{'t': t, 'p': p, 'iou': iou}", "iou desc, t, p", "y.t = x[1].t or y.p = x[1].p")})),
sco as (select *, 0.7 * weighted_iou + 0.3 * greatest(0::double, 1 - abs(n_pred - n_true) / greatest(n_true, 1)) as score from (select prot, coalesce(a.n, 0) as n_true, coalesce(b.n, 0) as n_pred, coalesce(g.n_good, 0) as n_good,
  case when coalesce(a.n, 0) = 0 then 1.0::double else coalesce(g.hit, 0) / a.len end as weighted_iou from (select prot, count(*) as n, sum(e - s + 1) as len from tr group by prot) a
  full join (select prot, count(*) as n from pr group by prot) b using (prot)
  left join (select m.prot, sum(m.iou * (t.e - t.s + 1)) as hit, count(*) filter (m.iou >= 0.8) as n_good from mt m join tr t on t.prot = m.prot and t.dom = m.t group by m.prot) g using (prot))),
cls as (select *, case when n_true = 0 and n_pred = 0 then 'no_domains_correct' when n_true = 0 then 'false_positive' when n_pred = 0 then 'false_negative' when n_good = n_true and n_good = n_pred then 'correct'
  when n_pred < n_true then 'under_split' when n_pred > n_true then 'over_split' else 'boundary_error' end as error from sco)"""


@query("select prot, t, p, round(iou, 6) as iou from mt", _MATCH)
def x37_greedy_matches(spark, folder):
    return ev.matched(_pairs(spark, folder)).withColumn("iou", F.round("iou", 6))


@query("select prot, n_true, n_pred, n_good, round(weighted_iou, 6) as weighted_iou, round(score, 6) as score, case when score >= 0.9 then 'GOOD' when score >= 0.7 then 'OK' else 'BAD' end as status, error from cls", _MATCH)
def a27_protein_scores(spark, folder):
    """A27, A29, P32 and P33 for each protein."""
    true, pred = _sides(spark, folder)
    scores = ev.protein_scores(true, pred, ev.matched(_pairs(spark, folder)))
    return scores.withColumns({c: F.round(c, 6) for c in ("weighted_iou", "score")})


@query(
    """select count(*) as n, round(avg(weighted_iou), 6) as mean_iou, round(avg(abs(n_pred - n_true)), 6) as mean_count_error, count(*) filter (error = 'under_split') as n_under,
count(*) filter (error = 'over_split') as n_over, count(*) filter (error = 'correct') as n_correct from cls""",
    _MATCH,
)
def a29_benchmark_summary(spark, folder):
    true, pred = _sides(spark, folder)
    scores = ev.protein_scores(true, pred, ev.matched(_pairs(spark, folder)))
    return scores.agg(
        F.count("*").alias("n"),
        F.round(F.avg("weighted_iou"), 6).alias("mean_iou"),
        F.round(F.avg(F.abs(F.col("n_pred") - F.col("n_true"))), 6).alias("mean_count_error"),
        F.count_if(F.col("error") == "under_split").alias("n_under"),
        F.count_if(F.col("error") == "over_split").alias("n_over"),
        F.count_if(F.col("error") == "correct").alias("n_correct"),
    )


@query(
    """select x.tolerance, x.tp, y.fp, x.fn, round(case when x.tp = 0 then 0 else 2.0::double * x.tp / (x.tp + y.fp) * x.tp / (x.tp + x.fn) / (1.0::double * x.tp / (x.tp + y.fp) + 1.0::double * x.tp / (x.tp + x.fn)) end, 6) as f1
from (select k as tolerance, count(*) filter (found) as tp, count(*) filter (not found) as fn from (select k, exists (select 1 from pb where pb.prot = tb.prot and abs(pb.b - tb.b) <= k) as found from tb, unnest([5, 10, 15, 20, 25, 30]) as u(k)) group by k) x
join (select k as tolerance, count(*) filter (not found) as fp from (select k, exists (select 1 from tb where pb.prot = tb.prot and abs(pb.b - tb.b) <= k) as found from pb, unnest([5, 10, 15, 20, 25, 30]) as u(k)) group by k) y on y.tolerance = x.tolerance""",
    f"{_P}, tb as (select distinct prot, unnest([s, e]) as b from tr), pb as (select distinct prot, unnest([s, e]) as b from pr)",
)
def a28_boundary_f1(spark, folder):
    """A28 and J27."""
    return ev.boundary_f1(*_sides(spark, folder), [5, 10, 15, 20, 25, 30]).withColumn("f1", F.round("f1", 6))


@query(
    """select prot, n_true, n_pred, case when n_true = 0 then 'false_positive' when n_pred = 0 then 'false_negative' when n_pred < n_true then 'under_split' when n_pred > n_true then 'over_split' else 'same_count' end as class,
round(greatest(0::double, 1 - abs(n_pred - n_true) / greatest(n_true, 1)), 6) as count_score from (select coalesce(t.prot, p.prot) as prot, coalesce(t.n, 0) as n_true, coalesce(p.n, 0) as n_pred from (select prot, count(*) as n from tr group by prot) t full join (select prot, count(*) as n from pr group by prot) p on p.prot = t.prot)""",
    _P,
)
def p33_count_classes(spark, folder):
    true, pred = (df.groupBy("prot").agg(F.count("*").alias(n)) for df, n in zip(_sides(spark, folder), ("n_true", "n_pred"), strict=True))
    rows = true.join(pred, "prot", "full").fillna(0, ["n_true", "n_pred"])
    t, p = F.col("n_true"), F.col("n_pred")
    kind = F.when(t == 0, "false_positive").when(p == 0, "false_negative").when(p < t, "under_split").when(p > t, "over_split").otherwise("same_count")
    count_score = F.greatest(F.lit(0.0), 1 - F.abs(p - t) / F.greatest(t, F.lit(1)))
    return rows.select("prot", "n_true", "n_pred", kind.alias("class"), F.round(count_score, 6).alias("count_score"))


@query("select prot, len(string_split(list(concat(s, '-', e) order by s, e)::varchar, ',')) as n_domains, false as excluded from tr group by prot", _P)
def s24_truth_lines(spark, folder):
    ordered = F.sort_array(F.collect_list(F.struct("s", "e")))
    choppings = F.array_join(F.transform(ordered, lambda x: F.concat_ws("-", x["s"], x["e"])), " ")
    lines = _domains(spark, folder, TRUE).groupBy("prot").agg(choppings.alias("c")).select(F.concat_ws(" ", "prot", "c").alias("line"))
    rows = truth_lines(lines)
    return rows.select(F.col("acc").cast("bigint").alias("prot"), F.size("choppings").cast("bigint").alias("n_domains"), "excluded")
