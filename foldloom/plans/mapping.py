"""Structure domains, family regions and clans: interval joins and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldloom.functions import intervals as iv
from foldloom.functions.keys import accession
from foldloom.operators.intervals import overlap_join, without_overlap
from foldloom.operators.mapping import clan_mapping, many_label_families, matched_both_ways, ranked_list
from foldloom.plans.registry import Plans
from foldloom.sources import fixtures as fx
from foldloom.sources.tables import table

query = Plans()
QUERIES, ORACLES = query.queries, query.oracles

_SEGS = """segs as (select okey, ln, acc, fam, cath, consensus_level, chopping, cast(split_part(x, '-', 1) as bigint) as s, cast(split_part(x, '-', 2) as bigint) as e
  from (select *, unnest(string_split(chopping, '_')) as x from fx_ted) where regexp_full_match(x, '[0-9]+-[0-9]+')),
pairs as (select g.okey as d_okey, g.ln as d_ln, g.acc, g.fam as d_fam, g.cath, g.consensus_level, p.okey, p.ln, p.fam, p.seq_start, p.seq_end,
  sum(greatest(0, least(g.e, p.seq_end) - greatest(g.s, p.seq_start) + 1)) as common, sum(g.e - g.s + 1) as d_len
  from segs g join fx_family p on p.acc = g.acc group by all),
hit as (select * from pairs where common > 0 and common >= 0.5 * d_len and common >= 0.5 * (seq_end - seq_start + 1)),
counts as (select cath as label, consensus_level as level, fam, count(*) as n from hit group by all),
clan as (select c.label, c.level, k.clan_acc, cast(sum(c.n) as bigint) as n_total, count(*) as n_families,
  array_to_string((list(c.fam order by c.n desc, c.fam))[1:3], ',') as top_families from counts c join fx_clan k on k.fam = c.fam where k.clan_acc is not null group by all)"""


def _matches(spark, folder):
    domains = fx.structure_domains(spark, folder).withColumnsRenamed({"okey": "d_okey", "ln": "d_ln", "fam": "d_fam"})
    return matched_both_ways(domains, fx.family_regions(spark, folder))


def _counts(spark, folder):
    return _matches(spark, folder).groupBy(F.col("cath").alias("label"), F.col("consensus_level").alias("level"), "fam").agg(F.count("*").alias("n"))


@query("select d_okey, d_ln, acc, okey, ln, fam, seq_start, seq_end, cast(common as bigint) as common from hit", _SEGS)
def j01_interval_join_bidir(spark, folder):
    return _matches(spark, folder).select("d_okey", "d_ln", "acc", "okey", "ln", "fam", "seq_start", "seq_end", "common")


@query("select * from counts", _SEGS)
def a01_count_by_label_family(spark, folder):
    return _counts(spark, folder)


@query(
    """select label, level, clan_acc, n_total, n_families, top_families,
round(n_total / sum(n_total) over (partition by label, level), 4) as confidence from clan""",
    _SEGS,
)
def a02_cath_clan_mapping(spark, folder):
    return clan_mapping(_counts(spark, folder), fx.clans(spark, folder).select("fam", "clan_acc"))


@query("""select label, level, cast(sum(n_total) as bigint) as n_label, round(max(n_total) / sum(n_total), 6) as top_confidence from clan group by label, level""", _SEGS)
def a03_confidence(spark, folder):
    mapped = clan_mapping(_counts(spark, folder), fx.clans(spark, folder).select("fam", "clan_acc"))
    return mapped.groupBy("label", "level").agg(F.sum("n_total").alias("n_label"), F.round(F.max("n_total") / F.sum("n_total"), 6).alias("top_confidence"))


@query(
    """select fam, count(*) as n_labels, cast(sum(n) as bigint) as n_total, round(max(n) / sum(n), 6) as dominance,
array_to_string(list(concat(label, ':', n) order by n desc, label), ',') as labels
from (select fam, label, cast(sum(n) as bigint) as n from counts group by all) group by fam having count(*) >= 2""",
    _SEGS,
)
def a04_multi_label_families(spark, folder):
    counts = _counts(spark, folder).groupBy("fam", "label").agg(F.sum("n").alias("n"))
    return many_label_families(counts)


@query("select label, level, fam, n from (select *, row_number() over (partition by label, level order by n desc, fam) as k from counts) where k <= 3", _SEGS)
def w15_top_families_per_label(spark, folder):
    by = Window.partitionBy("label", "level").orderBy(F.desc("n"), "fam")
    return _counts(spark, folder).withColumn("k", F.row_number().over(by)).where("k <= 3").drop("k")


@query(
    "select label, level, clan_acc, n_total, format('{:.4f}', n_total / sum(n_total) over (partition by label, level)) as confidence, top_families from clan",
    _SEGS,
)
def k01_clan_mapping_lines(spark, folder):
    mapped = clan_mapping(_counts(spark, folder), fx.clans(spark, folder).select("fam", "clan_acc"))
    return mapped.select("label", "level", "clan_acc", "n_total", F.format_string("%.4f", "confidence").alias("confidence"), "top_families")


@query("select fam, array_to_string(list(concat(label, '/', level, ':', n) order by n desc, concat(label, '/', level)), ',') as labels from counts group by fam", _SEGS)
def k02_label_lists(spark, folder):
    return _counts(spark, folder).groupBy("fam").agg(ranked_list(F.concat_ws("/", "label", "level"), F.col("n"), with_count=True).alias("labels"))


@query(
    """select distinct t.okey, t.ln, t.acc, t.fam from fx_ted t where not exists (
select 1 from segs g join fx_family p on p.acc = g.acc and g.s <= p.seq_end and p.seq_start <= g.e where g.okey = t.okey and g.ln = t.ln and g.acc = t.acc and g.fam = t.fam)""",
    _SEGS,
)
def j02_domains_without_family(spark, folder):
    segs = fx.structure_domains(spark, folder).select("okey", "ln", "acc", "fam", F.inline(iv.segments("chopping")))
    return without_overlap(segs, fx.family_regions(spark, folder), "acc", ["okey", "ln", "fam"], "s", "e", "seq_start", "seq_end").select("okey", "ln", "acc", "fam")


@query("select okey, ln, acc, fam from fx_ted where acc in (select p_partkey from part where p_size > 25)")
def j03_in_sequence_universe(spark, folder):
    known = table(spark, folder, "part").where("p_size > 25").select(F.col("p_partkey").alias("acc"))
    return fx.structure_domains(spark, folder).join(known, "acc", "left_semi").select("okey", "ln", "acc", "fam")


_SEED = """seed as (select acc, fam as sfam, okey as sokey, ln as sln, s as seed_s, e as seed_e from fx_region where src = 'O'),
cover as (select d.acc, d.sokey, d.sln, d.sfam, d.seed_s, d.seed_e, g.okey, g.ln, g.fam, g.cath, g.consensus_level,
  sum(greatest(0, least(d.seed_e, g.e) - greatest(d.seed_s, g.s) + 1)) * 1.0::double / max(d.seed_e - d.seed_s + 1) as covered
  from seed d join segs g on g.acc = d.acc group by all),
best as (select * from cover where covered >= 0.5)"""


def _seed(spark, folder):
    """Every region as a seed row."""
    return fx.hits(spark, folder).where("src = 'O'").selectExpr("acc", "okey as sokey", "ln as sln", "fam as sfam", "s as seed_s", "e as seed_e")


def _covered(spark, folder):
    """Seed sequences with the structure domains that cover at least half of them."""
    domains = iv.with_spans(fx.structure_domains(spark, folder), "chopping")
    met = overlap_join(_seed(spark, folder), domains, "acc", "seed_s", "seed_e", "span_s", "span_e")
    met = met.where(iv.overlap("span_s", "span_e", "seed_s", "seed_e") >= 0.5 * (F.col("seed_e") - F.col("seed_s") + 1))
    covered = iv.segments_overlap("segs", "seed_s", "seed_e") / (F.col("seed_e") - F.col("seed_s") + 1)
    return met.withColumn("covered", covered).where("covered >= 0.5")


_SEED_COVERAGE_SQL = """select d.acc, d.sokey, d.sln, d.sfam, d.seed_s, d.seed_e, count(b.okey) as n_matches, max(round(b.covered, 6)) as best
from seed d left join best b using (acc, sokey, sln, sfam, seed_s, seed_e) group by all"""


def _seed_coverage(spark, folder):
    keys = ["acc", "sokey", "sln", "sfam", "seed_s", "seed_e"]
    found = _covered(spark, folder).groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.round("covered", 6)).alias("best"))
    seed = _seed(spark, folder).groupBy(*keys).agg(F.count("*").alias("times"))
    return seed.join(found, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"), "best")


_SPAN_REPORT_SQL = """select t.acc, t.okey, t.ln, d.sokey, d.sln, round(greatest(0, least(t.e, d.seed_e) - greatest(t.s, d.seed_s) + 1) * 100.0::double / (t.e - t.s + 1), 4) as percent
from (select okey, ln, acc, fam, min(s) as s, max(e) as e from segs group by okey, ln, acc, fam, chopping) t join seed d on d.acc = t.acc"""


def _span_report(spark, folder):
    spans = iv.with_spans(fx.structure_domains(spark, folder), "chopping").selectExpr("okey", "ln", "acc", "span_s as s", "span_e as e")
    percent = F.round(iv.overlap_percent("s", "e", "seed_s", "seed_e"), 4)
    return spans.join(_seed(spark, folder), "acc").select("acc", "okey", "ln", "sokey", "sln", percent.alias("percent"))


_FIRST_OVERLAP_SQL = """select acc, okey, ln, sfam from (select t.acc, t.okey, t.ln, d.sfam, row_number() over (partition by t.acc, t.okey, t.ln, t.fam order by d.sokey, d.sln, d.sfam, d.seed_s, d.seed_e) as k
from (select okey, ln, acc, fam, min(s) as s, max(e) as e from segs group by okey, ln, acc, fam, chopping) t join seed d on d.acc = t.acc
where greatest(0, least(t.e, d.seed_e) - greatest(t.s, d.seed_s) + 1) > 0.5 * (t.e - t.s + 1)) where k = 1"""


def _first_overlap(spark, folder):
    spans = iv.with_spans(fx.structure_domains(spark, folder), "chopping").selectExpr("okey", "ln", "acc", "fam", "span_s as s", "span_e as e")
    met = overlap_join(spans, _seed(spark, folder), "acc", "s", "e", "seed_s", "seed_e")
    met = met.where(iv.overlap("s", "e", "seed_s", "seed_e") > 0.5 * (F.col("e") - F.col("s") + 1))
    first = Window.partitionBy("acc", "okey", "ln", "fam").orderBy("sokey", "sln", "sfam", "seed_s", "seed_e")
    return met.withColumn("k", F.row_number().over(first)).where("k = 1").select("acc", "okey", "ln", "sfam")


_MID = """mid as (select a.fam as fam_a, b.fam as fam_b, a.acc, a.evalue as ea, b.evalue as eb, a.okey as ao, a.ln as al, b.okey as bo, b.ln as bl
  from fx_region a join fx_region b on a.acc = b.acc and (a.okey, a.ln, a.fam, a.s, a.e) < (b.okey, b.ln, b.fam, b.s, b.e) and a.s <= b.e and b.s <= a.e
  and ((a.s + a.e > 2 * b.s and a.s + a.e < 2 * b.e) or (b.s + b.e > 2 * a.s and b.s + b.e < 2 * a.e)))"""


def _midpoint_pairs(spark, folder):
    a = fx.hits(spark, folder).selectExpr("acc", "okey as ao", "ln as al", "fam as fam_a", "s as a_s", "e as a_e", "evalue as ea")
    b = fx.hits(spark, folder).selectExpr("acc", "okey as bo", "ln as bl", "fam as fam_b", "s as b_s", "e as b_e", "evalue as eb")
    met = overlap_join(a, b, "acc", "a_s", "a_e", "b_s", "b_e")
    ordered = F.struct("ao", "al", "fam_a", "a_s", "a_e") < F.struct(
        F.col("bo").alias("ao"), F.col("bl").alias("al"), F.col("fam_b").alias("fam_a"), F.col("b_s").alias("a_s"), F.col("b_e").alias("a_e")
    )
    return met.where(ordered & iv.midpoint_inside("a_s", "a_e", "b_s", "b_e"))


@query("select acc, ao, al, bo, bl, fam_a, fam_b from mid", _MID)
def j07_midpoint_self_join(spark, folder):
    return _midpoint_pairs(spark, folder).select("acc", "ao", "al", "bo", "bl", "fam_a", "fam_b")


@query(
    "select least(fam_a, fam_b) as fam_1, greatest(fam_a, fam_b) as fam_2, count(*) as n_common, round(sum(exp(-ea) * exp(-eb)), 4) as sum_score from mid where fam_a <> fam_b group by all",
    _MID,
)
def a05_family_pair_counts(spark, folder):
    pairs = _midpoint_pairs(spark, folder).where("fam_a <> fam_b")
    keys = [F.least("fam_a", "fam_b").alias("fam_1"), F.greatest("fam_a", "fam_b").alias("fam_2")]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_common"), F.round(F.sum(F.exp(-F.col("ea")) * F.exp(-F.col("eb"))), 4).alias("sum_score"))


@query(
    """select d.okey, d.ln, d.acc, p.okey as pokey, p.ln as pln, p.fam as pfam from fx_ted d join segs g using (okey, ln, acc, fam, cath, consensus_level, chopping)
join fx_family p on p.acc = d.acc and g.s <= (p.seq_start + p.seq_end) // 2 and (p.seq_start + p.seq_end) // 2 <= g.e""",
    _SEGS,
)
def j08_point_in_interval(spark, folder):
    segs = fx.structure_domains(spark, folder).select("okey", "ln", "acc", F.inline(iv.segments("chopping")))
    regions = fx.family_regions(spark, folder).withColumn("middle", F.expr("(seq_start + seq_end) div 2"))
    points = regions.selectExpr("acc", "okey as pokey", "ln as pln", "fam as pfam", "middle", "middle as middle_end")
    return overlap_join(segs, points, "acc", "s", "e", "middle", "middle_end").select("okey", "ln", "acc", "pokey", "pln", "pfam")


@query("select p.okey, p.ln, p.acc, p.fam, k.clan_acc from fx_family p join fx_clan k on k.fam = p.fam where k.clan_acc is not null")
def j09_family_to_clan(spark, folder):
    known = fx.clans(spark, folder).where("clan_acc is not null").select("fam", "clan_acc")
    return fx.family_regions(spark, folder).join(known, "fam").select("okey", "ln", "acc", "fam", "clan_acc")


_ACC = "nullif(upper(trim(split_part({0}, '.', 1), ' ' || chr(9) || chr(10) || chr(13))), '')"
_REAL = f"""hits as (select region_id, {_ACC.format("id")} as id, {_ACC.format("family")} as family, seq_start, seq_end, evalue from region_hits),
good as (select * from hits where id is not null and family is not null and seq_start <= seq_end)"""


def _good(spark, folder):
    rows = table(spark, folder, "region_hits").select("region_id", accession("id").alias("id"), accession("family").alias("family"), "seq_start", "seq_end", "evalue")
    return rows.where("id is not null and family is not null and seq_start <= seq_end")


@query(
    """select g.family, count(*) as n, case when c.pfama_acc is null then 'Unknown' when c.clan_acc is null then 'No_clan' else c.clan_acc end as clan
from good g left join clan_membership c on c.pfama_acc = g.family group by all""",
    _REAL,
)
def j10_clan_with_default(spark, folder):
    known = table(spark, folder, "clan_membership").select(F.col("pfama_acc").alias("family"), "clan_acc", F.lit(True).alias("known"))
    counts = _good(spark, folder).groupBy("family").agg(F.count("*").alias("n"))
    clan = F.when(F.col("known").isNull(), "Unknown").otherwise(F.coalesce("clan_acc", F.lit("No_clan")))
    return counts.join(known, "family", "left").select("family", "n", clan.alias("clan"))


@query(
    """select g.family, p.pfama_id, p.family_type, c.clan_acc, c.clan_id, count(*) as n_regions, count(distinct g.id) as n_ids
from good g left join pfama p on p.pfama_acc = g.family left join clan_membership c on c.pfama_acc = g.family group by all""",
    _REAL,
)
def j11_family_clan_tables(spark, folder):
    counts = _good(spark, folder).groupBy("family").agg(F.count("*").alias("n_regions"), F.countDistinct("id").alias("n_ids"))
    named = table(spark, folder, "pfama").select(F.col("pfama_acc").alias("family"), "pfama_id", "family_type")
    clans = table(spark, folder, "clan_membership").withColumnRenamed("pfama_acc", "family")
    return counts.join(named, "family", "left").join(clans, "family", "left").select("family", "pfama_id", "family_type", "clan_acc", "clan_id", "n_regions", "n_ids")


@query(
    """select a.pfama_acc, coalesce(a.pfama_id, 'Unknown') as pfama_id, coalesce(a.family_type, 'Domain') as family_type, coalesce(a.model_length, 100) as model_length,
coalesce(c.clan_acc, 'No_clan') as clan_acc from pfama a left join clan_membership c on c.pfama_acc = a.pfama_acc"""
)
def j12_family_info(spark, folder):
    clans = table(spark, folder, "clan_membership").select("pfama_acc", "clan_acc")
    filled = {"pfama_id": "Unknown", "family_type": "Domain", "model_length": 100, "clan_acc": "No_clan"}
    rows = table(spark, folder, "pfama").join(clans, "pfama_acc", "left")
    return rows.select("pfama_acc", *[F.coalesce(F.col(c), F.lit(v).cast(rows.schema[c].dataType)).alias(c) for c, v in filled.items()])


@query("select count(*) as n, count(distinct acc) as n_acc, count(*) filter (consensus_level = 'high') as n_high, count(*) filter (consensus_level = 'medium') as n_medium, count(*) filter (consensus_level = 'low') as n_low from fx_ted")
def a11_index_stats(spark, folder):
    level = F.col("consensus_level")
    counts = [F.count_if(level == x).alias(f"n_{x}") for x in ("high", "medium", "low")]
    return fx.structure_domains(spark, folder).agg(F.count("*").alias("n"), F.countDistinct("acc").alias("n_acc"), *counts)


@query("select consensus_level, round(count(*) / count(distinct acc), 6) as mean_domains from fx_ted group by consensus_level")
def a12_mean_domains(spark, folder):
    return fx.structure_domains(spark, folder).groupBy("consensus_level").agg(F.round(F.count("*") / F.countDistinct("acc"), 6).alias("mean_domains"))


_LABELLED = f"""labelled as (select domain_id, uniprot_acc, cath_label, cath_label as h_group, array_to_string(string_split(cath_label, '.')[1:3], '.') as t_group,
  array_to_string(string_split(cath_label, '.')[1:2], '.') as ca_group from ted_domains where cath_label is not null and cath_label <> '-')"""


def _labelled(spark, folder):
    rows = table(spark, folder, "ted_domains").where("cath_label is not null and cath_label <> '-'")
    groups = {k: F.substring_index("cath_label", ".", n) for k, n in (("h_group", 4), ("t_group", 3), ("ca_group", 2))}
    return rows.withColumns(groups)


@query(
    "select 'H' as level, h_group as label, count(*) as n from labelled group by h_group union all select 'T', t_group, count(*) from labelled group by t_group union all select 'CA', ca_group, count(*) from labelled group by ca_group",
    _LABELLED,
)
def a13_group_counts(spark, folder):
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).alias("label")) for k, c in (("H", "h_group"), ("T", "t_group"), ("CA", "ca_group"))]))
    return _labelled(spark, folder).select(levels.alias("x")).groupBy("x.level", "x.label").agg(F.count("*").alias("n"))


@query("select domain_id, h_group, t_group, ca_group from labelled", _LABELLED)
def p17_label_roll_up(spark, folder):
    return _labelled(spark, folder).select("domain_id", "h_group", "t_group", "ca_group")


_MANY_GROUP_SEQUENCES_SQL = "select acc, sokey, sln, sfam, n_groups from (select acc, sokey, sln, sfam, seed_s, seed_e, count(distinct cath) as n_groups from best group by all) where n_groups > 1"


def _many_group_sequences(spark, folder):
    keys = ["acc", "sokey", "sln", "sfam", "seed_s", "seed_e"]
    rows = _covered(spark, folder).groupBy(*keys).agg(F.countDistinct("cath").alias("n_groups")).where("n_groups > 1")
    return rows.select("acc", "sokey", "sln", "sfam", "n_groups")


_BEST_MATCH_PER_SEQUENCE_SQL = """select acc, sokey, sln, sfam, seed_s, seed_e, cath, round(covered, 6) as covered from (select *, row_number() over (partition by acc, sokey, sln, sfam, seed_s, seed_e
order by round(covered, 6) desc, okey, ln, fam) as k from best) where k = 1"""


def _best_match_per_sequence(spark, folder):
    keys = ["acc", "sokey", "sln", "sfam", "seed_s", "seed_e"]
    first = Window.partitionBy(*keys).orderBy(F.desc("covered"), "okey", "ln", "fam")
    rows = _covered(spark, folder).withColumn("covered", F.round("covered", 6))
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select(*keys, "cath", "covered")


@query("select domain_id, regexp_extract(ted_id, '^AF-([A-Z0-9]+)-F[0-9]+-.*_TED[0-9]+$', 1) as acc, regexp_extract(ted_id, '_(TED[0-9]+)$', 1) as suffix, coalesce(consensus_level, 'unknown') as level from ted_domains")
def s01_domain_ids(spark, folder):
    return table(spark, folder, "ted_domains").select(
        "domain_id",
        F.regexp_extract("ted_id", r"^AF-([A-Z0-9]+)-F[0-9]+-.*_TED[0-9]+$", 1).alias("acc"),
        F.regexp_extract("ted_id", r"_(TED[0-9]+)$", 1).alias("suffix"),
        F.coalesce("consensus_level", F.lit("unknown")).alias("level"),
    )


@query("select okey, ln, acc, fam, cast(split_part(split_part(chopping, '_', 1), '-', 1) as bigint) as first_start, cast(split_part(string_split(chopping, '_')[-1], '-', 2) as bigint) as last_end from fx_ted where consensus_level = 'high'")
def s07_high_confidence_spans(spark, folder):
    segs = iv.segments("chopping")
    rows = fx.structure_domains(spark, folder).where("consensus_level = 'high'")
    return rows.select("okey", "ln", "acc", "fam", F.element_at(segs, 1)["s"].alias("first_start"), F.element_at(segs, -1)["e"].alias("last_end"))


@query("select okey, ln, acc, fam, s, e from segs", _SEGS)
def p01_parse_chopping(spark, folder):
    return fx.structure_domains(spark, folder).select("okey", "ln", "acc", "fam", F.inline(iv.segments("chopping")))


_MULTI = """joined as (select acc, array_to_string(list(chopping order by okey, ln, fam, chopping), ',') as c from fx_ted where consensus_level = 'high' group by acc)"""


def _joined(spark, folder):
    rows = fx.structure_domains(spark, folder).where("consensus_level = 'high'")
    ordered = F.sort_array(F.collect_list(F.struct("okey", "ln", "fam", "chopping")))
    return rows.groupBy("acc").agg(F.array_join(F.transform(ordered, lambda x: x["chopping"]), ",").alias("c"))


@query("select acc, k as dom_no, string_split(c, ',')[k] as chopping, len(string_split(string_split(c, ',')[k], '_')) as n_segments from joined, unnest(range(1, len(string_split(c, ',')) + 1)) as u(k)", _MULTI)
def p02_parse_many_domains(spark, folder):
    rows = _joined(spark, folder).select("acc", F.posexplode(iv.domains("c")).alias("k", "segs"))
    return rows.select("acc", (F.col("k") + 1).cast("bigint").alias("dom_no"), iv.chopping("segs").alias("chopping"), F.size("segs").cast("bigint").alias("n_segments"))


@query("select okey, ln, acc, fam, chopping from fx_ted")
def p03_chopping_round_trip(spark, folder):
    return fx.structure_domains(spark, folder).select("okey", "ln", "acc", "fam", iv.chopping(iv.segments("chopping")).alias("chopping"))


@query(
    """select t.okey, t.ln, t.acc, p.okey as pokey, p.ln as pln, greatest(0, least(t.e, p.seq_end) - greatest(t.s, p.seq_start) + 1) as n_common,
round(greatest(0, least(t.e, p.seq_end) - greatest(t.s, p.seq_start) + 1) * 100.0::double / (t.e - t.s + 1), 4) as percent,
round(case when greatest(t.s, p.seq_start) >= least(t.e, p.seq_end) then 0::double else (least(t.e, p.seq_end) - greatest(t.s, p.seq_start) + 1) / least(t.e - t.s + 1, p.seq_end - p.seq_start + 1) end, 6) as of_shorter,
round(greatest(0::double, 1 - abs(t.s - p.seq_start) / 10.0::double), 6) as start_similarity
from segs t join fx_family p on p.acc = t.acc and t.s <= p.seq_end and p.seq_start <= t.e""",
    _SEGS,
)
def p04_overlap_measures(spark, folder):
    """P04, P05, P07, P24 and P25 over one join."""
    segs = fx.structure_domains(spark, folder).select("okey", "ln", "acc", F.inline(iv.segments("chopping")))
    regions = fx.family_regions(spark, folder).selectExpr("acc", "okey as pokey", "ln as pln", "seq_start", "seq_end")
    ends = ("s", "e", "seq_start", "seq_end")
    return overlap_join(segs, regions, "acc", *ends).select(
        "okey",
        "ln",
        "acc",
        "pokey",
        "pln",
        iv.residue_overlap(*ends).alias("n_common"),
        F.round(iv.overlap_percent(*ends), 4).alias("percent"),
        F.round(iv.shorter_fraction(*ends), 6).alias("of_shorter"),
        F.round(iv.boundary_similarity("s", "seq_start", 10), 6).alias("start_similarity"),
    )


@query("select region_id, id, family from hits where id is not null", _REAL)
def p08_bare_accessions(spark, folder):
    rows = table(spark, folder, "region_hits").select("region_id", accession("id").alias("id"), accession("family").alias("family"))
    return rows.where("id is not null")


@query(
    """select line_id, regexp_extract(raw_line, '^"?([A-Z0-9]+)\\.([0-9]+)/([0-9]+)-([0-9]+)', 1) as acc, try_cast(regexp_extract(raw_line, '^"?([A-Z0-9]+)\\.([0-9]+)/([0-9]+)-([0-9]+)', 3) as bigint) as first,
try_cast(regexp_extract(raw_line, '^"?([A-Z0-9]+)\\.([0-9]+)/([0-9]+)-([0-9]+)', 4) as bigint) as last from alignment_lines where regexp_matches(raw_line, '^"?([A-Z0-9]+)\\.([0-9]+)/([0-9]+)-([0-9]+)')"""
)
def p09_sequence_ids(spark, folder):
    form = r'^"?([A-Z0-9]+)\.([0-9]+)/([0-9]+)-([0-9]+)'
    rows = table(spark, folder, "alignment_lines").where(F.col("raw_line").rlike(form))
    part = lambda k: F.regexp_extract("raw_line", form, k)
    return rows.select("line_id", part(1).alias("acc"), F.expr(f"try_cast(regexp_extract(raw_line, r'{form}', 3) as bigint)").alias("first"), F.expr(f"try_cast(regexp_extract(raw_line, r'{form}', 4) as bigint)").alias("last"))


@query("select line_id, regexp_extract(raw_line, '(PF[0-9]{5,})', 1) as family from region_lines where raw_line is not null")
def p10_family_from_text(spark, folder):
    rows = table(spark, folder, "region_lines").where("raw_line is not null")
    return rows.select("line_id", F.regexp_extract("raw_line", r"(PF[0-9]{5,})", 1).alias("family"))


@query(
    """select p.family, count(*) as n, round(avg(g.seq_end - g.seq_start + 1), 6) as mean_length, max(g.seq_end) as last from good g join (select distinct family from good where evalue < 1e-10) p on p.family = g.family group by p.family""",
    _REAL,
)
def s06_significant_families(spark, folder):
    good = _good(spark, folder)
    strong = good.where("evalue < 1e-10").select("family").distinct()
    length = F.col("seq_end") - F.col("seq_start") + 1
    return good.join(strong, "family", "left_semi").groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(length), 6).alias("mean_length"), F.max("seq_end").alias("last"))


@query("select distinct g.id from good g where not exists (select 1 from ted_domains t where t.uniprot_acc = g.id)", _REAL)
def a09_proteins_without_domain(spark, folder):
    known = table(spark, folder, "ted_domains").select(F.col("uniprot_acc").alias("id"))
    return _good(spark, folder).select("id").distinct().join(known, "id", "left_anti")


@query(_SEED_COVERAGE_SQL, f"{_SEGS}, {_SEED}")
def j04_seed_coverage(spark, folder):
    return _seed_coverage(spark, folder)


@query(_SPAN_REPORT_SQL, f"{_SEGS}, {_SEED}")
def j05_span_report(spark, folder):
    return _span_report(spark, folder)


@query(_FIRST_OVERLAP_SQL, f"{_SEGS}, {_SEED}")
def j06_first_overlap(spark, folder):
    return _first_overlap(spark, folder)


@query(_MANY_GROUP_SEQUENCES_SQL, f"{_SEGS}, {_SEED}")
def a13_many_group_sequences(spark, folder):
    return _many_group_sequences(spark, folder)


@query(_BEST_MATCH_PER_SEQUENCE_SQL, f"{_SEGS}, {_SEED}")
def w14_best_match_per_sequence(spark, folder):
    return _best_match_per_sequence(spark, folder)


for _name in ("j04_seed_coverage", "j05_span_report", "j06_first_overlap", "a13_many_group_sequences", "w14_best_match_per_sequence"):
    query.also(_name, f"{_name}_all")
