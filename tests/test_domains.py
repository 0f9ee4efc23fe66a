import random

from foldloom.functions import intervals as iv
from foldloom.functions.scores import wilson_lower_bound
from foldloom.operators import consensus as co
from foldloom.operators import curation as cu
from foldloom.operators import evaluation as ev
from foldloom.operators import structure as st
from foldloom.operators.alignment import occupancy, sliced, span_to_columns
from foldloom.operators.islands import merged, runs
from foldloom.operators.mapping import matched_both_ways
from foldloom.operators.networks import best_edges, neighbourhood
from foldloom.sources import lines as tx
from pyspark.sql import functions as F


def test_choppings(spark):
    df = spark.createDataFrame([("11-41_290-389",), ("x_1-2",), ("-",), ("",), (None,)], "c string")
    segs = iv.segments("c")
    rows = df.select(iv.chopping(segs).alias("c"), iv.total_length(segs).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("11-41_290-389", 131), ("1-2", 2), ("", 0), ("", 0), ("", 0)]


def test_wilson(spark):
    rows = spark.createDataFrame([(1, 1), (0, 0), (15, 20)], "k bigint, n bigint").select(wilson_lower_bound(F.col("k"), F.col("n")).alias("w")).collect()
    assert [round(r["w"], 4) for r in rows] == [0.2065, 0.0, 0.5313]


def test_matched_both_ways_sums_segments(spark):
    domains = spark.createDataFrame([("p", "1-10_21-30"), ("p", "1-5"), (None, "1-9")], "acc string, chopping string")
    regions = spark.createDataFrame([("p", 1, 30), ("p", 100, 120)], "acc string, seq_start bigint, seq_end bigint")
    assert [(r["chopping"], r["common"]) for r in matched_both_ways(domains, regions).collect()] == [("1-10_21-30", 20)]


def test_clusters_by_similarity(spark):
    r = random.Random(5)
    rows = [(k % 3, r.randint(1, 200), r.randint(50, 300)) for k in range(300)]
    df = spark.createDataFrame(rows, "prot int, s bigint, e bigint")
    got = {}
    for x in co.clusters_by_similarity(df, "prot", "s", "e", 6).collect():
        got[x["prot"], x["s"], x["e"]] = x["cluster"]
    for p in range(3):
        cluster, open_, want = -1, [], {}
        for s, e in sorted((s, e) for q, s, e in rows if q == p):
            if not any(abs(s - a) < 6 or abs(e - b) < 6 for a, b in open_):
                cluster, open_ = cluster + 1, []
            open_.append((s, e))
            want[p, s, e] = cluster
        assert {k: v for k, v in got.items() if k[0] == p} == want


def test_without_overlaps(spark):
    r = random.Random(6)
    rows = list({(k % 2, s, s + r.randint(5, 60), round(r.random(), 3)) for k in range(60) for s in [r.randint(1, 200)]})
    df = spark.createDataFrame(rows, "prot int, s bigint, e bigint, score double")
    got = sorted(map(tuple, co.without_overlaps(df, "prot", "s", "e", "score").collect()))
    want = []
    for p in range(2):
        kept = []
        for _, s, e, v in sorted((x for x in rows if x[0] == p), key=lambda x: (-x[3], x[1], x[2])):
            part = [max(0, min(e, b) - max(s, a) + 1) / min(e - s + 1, b - a + 1) if max(s, a) < min(e, b) else 0 for a, b in kept]
            if all(x <= 0.5 for x in part):
                kept.append((s, e))
                want.append((p, s, e, v))
    assert got == sorted(want)


def test_greedy_matches(spark):
    r = random.Random(7)
    pairs = [(p, t, q, r.choice([0.2, 0.5, 0.5, 0.9, r.random()])) for p in range(4) for t in range(6) for q in range(6) if r.random() < 0.7]
    got = sorted((x["prot"], x["t"], x["p"]) for x in ev.matched(spark.createDataFrame(pairs, "prot int, t bigint, p bigint, iou double")).collect())
    want = []
    for p in range(4):
        left = sorted((x for x in pairs if x[0] == p), key=lambda x: (-x[3], x[1], x[2]))
        while left:
            _, t, q, _ = left[0]
            want.append((p, t, q))
            left = [x for x in left if x[1] != t and x[2] != q]
    assert got == sorted(want)


def test_contacts_and_partitions(spark):
    r = random.Random(8)
    rows = [(p, k, *(r.uniform(-30, 30) + 100 * (k > 20) for _ in range(3)), 80.0) for p in (1, 2) for k in range(1, 41)]
    res = spark.createDataFrame(rows, "prot int, idx int, x double, y double, z double, plddt double")
    edges = st.contacts(res, 14.0, 2)
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and b[1] - a[1] >= 2 and sum((a[k] - b[k]) ** 2 for k in (2, 3, 4)) ** 0.5 <= 14}
    assert {(x["prot"], x["i"], x["j"]) for x in edges.collect()} == want
    weighted = st.weighted(edges, res, 20.0)
    found = st.communities(weighted).collect()
    assert all((x["idx"] > 20) == (x["dom"] > 20) for x in found)  # the two halves share no contact
    assert len({(x["prot"], x["dom"]) for x in found}) < len(found) / 2
    seeds = spark.createDataFrame([(1, 5, 1), (1, 30, 2)], "prot int, idx int, dom int")
    assert all((x["idx"] > 20) == (x["dom"] == 2) for x in st.grown(weighted, seeds, 1e-9).collect())


def test_runs_and_merged(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 6), ("b", 9)], "k string, i int")
    assert sorted((x["k"], x["seg_s"], x["seg_e"]) for x in runs(df, ["k"], "i", 3).collect()) == [("a", 1, 2), ("a", 6, 6), ("b", 9, 9)]
    spans = spark.createDataFrame([("a", 1, 50), ("a", 2, 5), ("a", 53, 60)], "k string, s int, e int")
    assert [(x["seg_s"], x["seg_e"], x["n"]) for x in merged(spans, ["k"], "s", "e", 2).collect()] == [(1, 50, 2), (53, 60, 1)]


def test_alignment_columns(spark):
    df = spark.createDataFrame([("f", "A-C.D", 10, 12), ("f", "--", 5, 4)], "family string, aln string, first bigint, last bigint")
    occ = {x["col"]: x["occ"] for x in occupancy(df, "family", "aln").collect()}
    assert occ == {0: 0.5, 1: 0.0, 2: 0.5, 3: 0.0, 4: 0.5}
    cut = [(x["part"], x["new_first"], x["new_last"]) for x in sliced(df, "aln", "first", F.lit(1), F.lit(3)).collect()]
    assert cut == [("-C.", 11, 11), ("-", 5, 4)]
    spans = df.withColumns({"s": F.lit(1), "e": F.lit(11)})
    assert [(x["col_s"], x["col_e"]) for x in span_to_columns(spans, "aln", "first", "last", "s", "e").collect()] == [(1, 3)]


def test_networks(spark):
    hits = spark.createDataFrame([("a", "b", 1e-5), ("b", "a", 1e-9), ("a", "a", 0.0), ("b", "c", 1e-2)], "q string, t string, evalue double")
    assert sorted((x["fam_1"], x["fam_2"], x["evalue"], x["n_rows"]) for x in best_edges(hits, "q", "t", "evalue").collect()) == [("a", "b", 1e-9, 2), ("b", "c", 1e-2, 1)]
    start = spark.createDataFrame([("a",)], "n string")
    assert {x["node"]: x["hop"] for x in neighbourhood(hits, "q", "t", start, "n", 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_resolution_and_records(spark):
    det = spark.createDataFrame([(1, "CL0001:FamA 3(10)"), (1, "CL0001:FamB 3(10)"), (2, "FamA 3(10)"), (3, "FamA 1(2)"), (3, "CL0001:FamB 1(2)"), (4, "junk")], "k int, d string")
    got = {x["k"]: (x["eligible"], x["reason"]) for x in cu.resolution_eligibility(cu.overlap_details(det, "d"), "k").collect()}
    assert got == {1: (True, "one clan"), 2: (True, "single family"), 3: (False, "some without clan")}
    rec = spark.createDataFrame([("ID   a|DE   b",)], "rec string")
    assert rec.select(cu.set_tag("rec", "CL", F.lit("x"), "ID").alias("r")).first()["r"] == "ID   a|CL   x|DE   b"


def test_text_formats(spark):
    line = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    hit = tx.profile_hits(line("  1 PF00002.3 some 99", " 12 PF00002  98.5 1.2E-20 3E-24 120.5 -1.5  88 3-90 5-92 (120)")).collect()
    assert [(h["rank"], h["target"], h["evalue"], h["ss"], h["template_length"]) for h in hit] == [(12, "PF00002", 1.2e-20, -1.5, 120)]
    truth = tx.truth_lines(line("A1 1-5_9-12 20-30", "B2", "C3 ?", "# x", "")).collect()
    assert [(t["acc"], t["choppings"], t["excluded"]) for t in truth] == [("A1", ["1-5_9-12", "20-30"], False), ("B2", [], False), ("C3", [], True)]
    assert [tuple(x)[1:] for x in tx.cross_reference(line("DR   STRING; 9606.ENSP1; -.", "DR   PDB; 1abc")).collect()] == [(9606, "ENSP1")]
    pae = tx.aligned_errors(line('{"predicted_aligned_error": [[0, 1.5], [2, 0]]}')).collect()
    assert [(x["i"], x["j"], x["pae"]) for x in pae] == [(1, 1, 0.0), (1, 2, 1.5), (2, 1, 2.0), (2, 2, 0.0)]
