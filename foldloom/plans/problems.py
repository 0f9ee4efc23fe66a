"""The registered queries of problems 1, 4, 5 and 6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions.keys import accession
from foldloom.operators.heavy_keys import figures_by_key
from foldloom.operators.packed_fields import unpack_ranges
from foldloom.operators.periods import periods_and_gaps
from foldloom.operators.raw_records import alignment_records, region_records
from foldloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    region = region_records(table(spark, folder, "region_lines")).select(F.lit("region").alias("feed"), "line_id", "state")
    alignment = alignment_records(table(spark, folder, "alignment_lines")).select(F.lit("alignment").alias("feed"), "line_id", "state")
    return region.unionAll(alignment).where("state = 'rejected'").select("feed", "line_id")


def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The rejected records, unchanged, with the reason."""
    region = region_records(table(spark, folder, "region_lines")).select(F.lit("region").alias("feed"), "line_id", "raw_line", "state", "reason")
    alignment = alignment_records(table(spark, folder, "alignment_lines")).select(F.lit("alignment").alias("feed"), "line_id", "raw_line", "state", "reason")
    return region.unionAll(alignment).where("state = 'rejected'").drop("state")


def p1_region_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The typed valid rows of the search feed."""
    rows = region_records(table(spark, folder, "region_lines")).where("state = 'valid'")
    return rows.select("line_id", "id", "family", "seq_start", "seq_end", "evalue", "description")


def p1_alignment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The typed valid rows of the alignment files."""
    rows = alignment_records(table(spark, folder, "alignment_lines")).where("state = 'valid'")
    return rows.select("line_id", "accession", "version", "seq_start", "seq_end", "aligned")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return unpack_ranges(table(spark, folder, "ted_domains"), "domain_id", "chopping").withColumnRenamed("row_id", "domain_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "region_hits").withColumn("id", accession("id"))
    return periods_and_gaps(hits, "id", "seq_start", "seq_end")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "region_hits").select(accession("family").alias("family"), accession("id").alias("id"), "evalue", "region_id")
    figures = figures_by_key(hits, "family", "id", "evalue", "region_id")
    return figures.select(F.col("key").alias("family"), F.col("n_rows").alias("n_regions"), F.col("n_items").alias("n_ids"), F.col("best_row_id").alias("best_region_id"))


_FIELD = r"""([^",\r\n]*|"(?:[^"]|"")*")"""
_CELL = "case when {0} like '\"%' then replace(substr({0}, 2, length({0}) - 2), '\"\"', '\"') else trim({0}, ' ' || chr(9)) end"
_LIVE = """
  select line_id, r from (select line_id, regexp_replace(raw_line, '\\r$', '') as r from {0} where raw_line is not null)
  where trim(r, ' ' || chr(9) || chr(10) || chr(13)) not in ('', '//') and not starts_with(r, '#')"""
_REGION = rf"""
region_live as ({_LIVE.format("region_lines")}),
region_cut as (select line_id, regexp_extract(r, '^{",".join([_FIELD] * 6)}$', ['a', 'b', 'c', 'd', 'e', 'f'], 's') as x,
  regexp_matches(r, '^{",".join([_FIELD] * 6)}$', 's') as whole from region_live),
region_cells as (select line_id, whole, {", ".join(f"{_CELL.format('x.' + k)} as {k}" for k in "abcdef")} from region_cut),
region_rows as (select *, try_cast(c as bigint) as s, try_cast(d as bigint) as t, try_cast(e as double) as v,
  whole and a <> '' and regexp_full_match(b, 'PF[0-9]{{5,}}') and regexp_full_match(c, '[0-9]+') and regexp_full_match(d, '[0-9]+')
  and regexp_full_match(e, '([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') as formed from region_cells),
region_valid as (select * from region_rows where formed and s >= 1 and s <= t and isfinite(v))"""
_ID = r'([A-Z0-9]{6}|[A-Z0-9]{10})\.([0-9]+)/([0-9]+)-([0-9]+)'
_ALIGNMENT = rf"""
alignment_live as ({_LIVE.format("alignment_lines")}),
alignment_cut as (select line_id, regexp_extract(trim(r, ' ' || chr(9)), '^("?){_ID}("?)[ \t]+([A-Za-z.\-]+)$', ['q1', 'acc', 'ver', 'a', 'b', 'q2', 'aln']) as x from alignment_live),
alignment_rows as (select line_id, x.acc as accession, try_cast(x.ver as bigint) as version, try_cast(x.a as bigint) as s, try_cast(x.b as bigint) as t, x.aln as aligned,
  x.acc <> '' and x.q1 = x.q2 as formed from alignment_cut),
alignment_valid as (select * from alignment_rows where formed and version >= 1 and s >= 1 and s <= t and length(regexp_replace(aligned, '[^A-Za-z]', '', 'g')) = t - s + 1)"""

_ACC = "nullif(upper(trim(split_part({0}, '.', 1), ' ' || chr(9) || chr(10) || chr(13))), '')"
_RANGE = "([0-9]+)(?:-|–|−|\\.\\.|:| - | – | − | to )([0-9]+)"

# the reasons, in the order in which they are looked for
_BARE, _QUOTED = r"""[^",\r\n]*""", r'"(?:[^"]|"")*"'
_REASONS = rf"""
region_why as (select l.line_id, o.raw_line, case when not regexp_matches(l.r, '^(?:{_BARE}|{_QUOTED})(?:,(?:{_BARE}|{_QUOTED}))*$', 's') then 'broken quoting'
  when f.n <> 6 then concat(f.n, ' field', case when f.n = 1 then '' else 's' end, ' instead of 6')
  when x.a = '' then 'empty id' when not regexp_full_match(x.b, 'PF[0-9]{{5,}}') then 'family isn''t an accession'
  when not regexp_full_match(x.c, '[0-9]+') or x.s is null then 'start isn''t a whole number' when not regexp_full_match(x.d, '[0-9]+') or x.t is null then 'end isn''t a whole number'
  when x.s < 1 then 'start under 1' when x.s > x.t then 'start behind end' else 'E-value isn''t a finite unsigned number' end as reason
  from region_live l join region_lines o using (line_id) join region_rows x using (line_id)
  join (select line_id, len(regexp_replace(r, '{_QUOTED}', 'q', 'gs')) - len(replace(regexp_replace(r, '{_QUOTED}', 'q', 'gs'), ',', '')) + 1 as n from region_live) f using (line_id)
  where line_id not in (select line_id from region_valid)),
alignment_parts as (select line_id, r, string_split(regexp_replace(trim(r, ' ' || chr(9)), '[ \t]+', chr(9), 'g'), chr(9)) as c from alignment_live),
alignment_why as (select p.line_id, o.raw_line, case when not regexp_matches(p.r, '^(?:"[^" \t]*"[ \t]+[^"]*|[^"]*)$', 's') then 'broken quoting'
  when len(p.c) <> 2 then concat(len(p.c), ' field', case when len(p.c) = 1 then '' else 's' end, ' instead of 2')
  when not regexp_full_match(q.id, '{_ID}') then 'full id isn''t accession.version/start-end'
  when coalesce(try_cast(regexp_extract(q.id, '{_ID}', 2) as bigint), 0) < 1 then 'version under 1'
  when coalesce(try_cast(regexp_extract(q.id, '{_ID}', 3) as bigint), 0) < 1 then 'start under 1'
  when try_cast(regexp_extract(q.id, '{_ID}', 4) as bigint) is null or try_cast(regexp_extract(q.id, '{_ID}', 3) as bigint) > try_cast(regexp_extract(q.id, '{_ID}', 4) as bigint) then 'start behind end'
  when not regexp_full_match(p.c[2], '[A-Za-z.\-]+') then 'sequence holds more than letters, - and .' else 'letters don''t fill start to end' end as reason
  from alignment_parts p join alignment_lines o using (line_id) join (select line_id, trim(c[1], '"') as id from alignment_parts) q using (line_id) where line_id not in (select line_id from alignment_valid))"""

ORACLES = {
    "p1_rejects": f"""with {_REGION}, {_ALIGNMENT}, {_REASONS}
select 'region' as feed, line_id, raw_line, reason from region_why union all select 'alignment', line_id, raw_line, reason from alignment_why""",
    "p1_found": f"""with {_REGION}, {_ALIGNMENT}
select 'region' as feed, line_id from region_live where line_id not in (select line_id from region_valid)
union all select 'alignment' as feed, line_id from alignment_live where line_id not in (select line_id from alignment_valid)""",
    "p1_region_rows": f"""with {_REGION} select line_id, a as id, b as family, s as seq_start, t as seq_end, v as evalue, f as description from region_valid""",
    "p1_alignment_rows": f"""with {_ALIGNMENT} select line_id, accession, version, s as seq_start, t as seq_end, aligned from alignment_valid""",
    "p4_found": f"""
with plain as (select domain_id, regexp_replace(regexp_replace(replace(chopping, ' and ', ';'),
    '"([0-9]+),([0-9]{{3}})-([0-9]+),([0-9]{{3}})"', '"\\1\\2-\\3\\4"', 'g'), '"([0-9]+)-([0-9]+),([0-9]{{3}})"', '"\\1-\\2\\3"', 'g') as c from ted_domains),
words as (select domain_id, regexp_extract_all(translate(c, '"''()[]{{}}', ''), '{_RANGE}|[^ _,;|/&+\\t]+') as w from plain),
each as (select domain_id, unnest(w) as v, generate_subscripts(w, 1) as seg_no from words)
select domain_id, seg_no, cast(regexp_extract(v, '^{_RANGE}$', 1) as bigint) as seg_start, cast(regexp_extract(v, '^{_RANGE}$', 2) as bigint) as seg_end
from each where regexp_matches(v, '^{_RANGE}$')""",
    "p5_found": f"""
with r as (select {_ACC.format("id")} as id, seq_start as s, seq_end as e from region_hits where seq_start <= seq_end),
m as (select id, s, e, max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) as before from r where id is not null),
g as (select id, s, e, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by id order by s, e) as k from m),
p as (select id, k, min(s) as a, max(e) as b from g group by id, k),
q as (select *, lead(a) over (partition by id order by k) as following from p)
select id, 'period' as stretch, a as seq_start, b as seq_end from p
union all select id, 'gap', b + 1, following - 1 from q where following is not null""",
    "p6_found": f"""
with r as (select {_ACC.format("family")} as family, {_ACC.format("id")} as id, evalue, region_id from region_hits),
b as (select family, region_id, row_number() over (partition by family order by evalue, region_id) as k from r where evalue is not null)
select r.family, count(*) as n_regions, count(distinct r.id) as n_ids, coalesce(max(b.region_id), 0) as best_region_id
from r left join b on b.family = r.family and b.k = 1 where r.family is not null group by r.family""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_region_rows, p1_alignment_rows, p4_found, p5_found, p6_found)}
