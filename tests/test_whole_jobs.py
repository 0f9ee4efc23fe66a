"""Queries that must see every row of their input, on tables small enough to count by hand."""

import __spark_entry__ as entry

QUERIES = entry.queries()


def _hits(spark, folder, rows):
    """lineitem from (okey, ln, acc, fam, src, s - 1, length - 21)."""
    names = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_linestatus string, l_extendedprice double, l_quantity double, l_returnflag string, l_discount double"
    spark.createDataFrame([(*r[:5], float(r[5]), float(r[6]), "ABN"[r[0] % 3], 0.05) for r in rows], names).write.parquet(f"{folder}/lineitem.parquet")


def test_every_region_is_a_seed(spark, tmp_path):
    _hits(spark, tmp_path, [(k, 1, 7, 3, "O", 10 * k, 29) for k in range(1, 8)] + [(k, 3, 7, 4, "F", 10 * k, 29) for k in range(20, 25)] + [(6, 3, 7, 4, "F", 60, 29), (8, 3, 7, 4, "F", 62, 29)])
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    cover = {r["sokey"]: r["n_matches"] for r in run("j04_seed_coverage_all")}
    assert cover == {1: 0, 2: 0, 3: 0, 4: 2, 5: 2, 6: 2, 7: 2}
    assert len(run("j05_span_report_all")) == 7 * 7
    assert {(r["okey"], r["sfam"]) for r in run("j06_first_overlap_all")} == {(6, 3), (8, 3)}
    assert {r["sokey"] for r in run("w14_best_match_per_sequence_all")} == {4, 5, 6, 7}
    assert {(r["sokey"], r["n_groups"]) for r in run("a13_many_group_sequences_all")} == {(k, 2) for k in (4, 5, 6, 7)}
