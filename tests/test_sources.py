import os
import random

import pytest
from pyspark.sql import functions as F

from foldloom import scratch
from foldloom.operators import curation as cu
from foldloom.operators.ordered import fill_forward, number_rows
from foldloom.sources import lines as tx
from foldloom.sources import writers as w
from foldloom.sources.tables import database_table


@pytest.mark.parametrize("seed", range(3))
def test_fill_forward(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice([None, None, None, f"v{k}"])) for k in range(200) if k // 20 % 3]
    got = {x["n"]: x["v"] for x in fill_forward(spark.createDataFrame(rows, "n bigint, v string").repartition(3), "n", "v", chunk=4).collect()}
    last, want = None, {}
    for k, v in rows:
        last = want[k] = v or last
    assert got == want
    assert fill_forward(spark.createDataFrame([], "n bigint, v string"), "n", "v").count() == 0


ALIGNMENT = """# a comment
A0A001.1/3-9   AC-D
B0B001.2/1-5   ..EF

   GH-
A0A001.1/3-9   IKL.
C0C001.1/1-2   MN
PQ
//
"""


def test_wrapped_alignments(spark, tmp_path):
    for name, text in (("x.aln", ALIGNMENT), ("y.aln", "stray\nA0A001.1/3-9 WW\n"), ("z.aln", "")):
        (tmp_path / name).write_text(text)
    rows = tx.alignment_blocks(tx.read_ordered_lines(spark, str(tmp_path)), "source", "place").collect()
    got = {(os.path.basename(x["source"]), x["full_id"]): (x["acc"], x["first"], x["last"], x["aln"]) for x in rows}
    assert got == {
        ("x.aln", "A0A001.1/3-9"): ("A0A001.1", 3, 9, "AC-DIKL."),
        ("x.aln", "B0B001.2/1-5"): ("B0B001.2", 1, 5, "..EFGH-"),
        ("x.aln", "C0C001.1/1-2"): ("C0C001.1", 1, 2, "MNPQ"),
        ("y.aln", "A0A001.1/3-9"): ("A0A001.1", 3, 9, "WW"),
    }


def test_columns_by_header(spark):
    rows = [("a", "protein1 x protein2 combined_score"), ("a", "p1 0 p2 900"), ("a", "p1 0 p3"), ("a", "p1 0 p3 high"), ("b", "combined_score protein2 protein1"), ("b", " 1 q2  q1 "), ("c", "q q 1")]
    df = spark.createDataFrame(rows, "file string, line string")
    fields = {"protein1": "string", "protein2": "string", "combined_score": "bigint"}
    got = {tuple(x) for x in tx.by_header(df, "file", fields, needed=("combined_score",)).select("file", *fields).collect()}
    assert got == {("a", "p1", "p2", 900), ("b", "q1", "q2", 1)}


MMCIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.auth_seq_id
_atom_site.label_asym_id
_atom_site.Cartn_y
_atom_site.Cartn_x
_atom_site.Cartn_z
_atom_site.B_iso_or_equiv
ATOM CA . MET -1 B 2.5 1.5 -3 88.10
ATOM CB . MET -1 B 9 9 9 9
ATOM CA B GLY 2 B 9 9 9 9
HETATM CA . CA 9 B 9 9 9 9
"""


def test_coordinate_tables(spark, tmp_path):
    (tmp_path / "m.cif").write_text(MMCIF)
    (tmp_path / "empty.cif").write_text("data_y\n")
    rows = tx.table_atoms(tx.read_ordered_lines(spark, str(tmp_path)), "source", "place").collect()
    assert [(x["resname"], x["chain"], x["resnum"], x["x"], x["y"], x["z"], x["plddt"]) for x in rows] == [("MET", "B", -1, 1.5, 2.5, -3.0, 88.1)]


def test_bonds_of_both_fields(spark):
    line = lambda n, a, b: f"{n:5d}{n:5d} A V  H                 {10:4d} {a:>11s}{b:>11s}"
    lines = [line(5, "-3,-0.3", "2,-1.5"), line(7, "-2,-9.9", "0, 0.0"), line(9, "4,-0.05", "")]
    rows = tx.secondary_structure(spark.createDataFrame([("p", x) for x in lines], "prot string, line string"))
    got = {(x["donor"], x["acceptor"], x["energy"]) for x in tx.hydrogen_bonds(rows, "prot").collect()}
    assert got == {(5, 2, -0.3), (5, 7, -1.5)}


def test_first_file_of_an_accession(spark, tmp_path):
    for name in ("PF00001_b.cif", "PF00001_a.cif", "PF00002.cif", "other.cif"):
        (tmp_path / name).write_text("x")
    got = {x["accession"]: os.path.basename(x["path"]) for x in tx.first_files(spark, str(tmp_path)).collect()}
    assert got == {"PF00001": "PF00001_a.cif", "PF00002": "PF00002.cif"}


def test_database_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(k, f"PF{k:05d}", k / 10) for k in range(50)], "id bigint, acc string, evalue double").write.jdbc(url, "regions", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    df = database_table(spark, url, "regions", "ID", (0, 50), 4).where("evalue < 1.0").select("acc")
    assert sorted(x["acc"] for x in df.collect()) == [f"PF{k:05d}" for k in range(10)]
    assert df.rdd.getNumPartitions() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EVALUE" in plan.upper().split("PUSHEDFILTERS")[1].split("]")[0] and "ID" not in plan.upper().split("READSCHEMA")[1].replace("STRUCT<ACC", "")


def test_lines_of_a_key_stay_in_order(spark, tmp_path):
    rows = [("hot", k, f"h{k:04d}") for k in range(400)] + [(f"k{k}", 1, "x") for k in range(10)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        w.write_lines_by_key(spark.createDataFrame(rows, "k string, n int, t string"), str(tmp_path / "o"), "k", "t", "n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted((tmp_path / "o" / "k=hot").glob("part-*"))
    assert [x for f in files for x in f.read_text().split()] == [f"h{k:04d}" for k in range(400)]


def test_workspace_deletes_what_was_cut(spark):
    kept = scratch.cut(spark.range(3))
    with scratch.workspace(spark):
        inner = scratch.cut(spark.range(5))
        with scratch.workspace(spark):
            number_rows(spark.range(4), ["id"], "n").count()
        assert inner.count() == 5
        pile = scratch.Pile(inner, "pile")
        assert pile.rows().count() == 0
        pile.add(inner)
        pile.add(inner)
        assert pile.rows().count() == 10
        at = inner.inputFiles()[0].split("foldloom-", 1)
        folder = os.path.dirname(inner.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
        assert at and os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.count() == 3


def test_records(spark):
    df = spark.createDataFrame([("ID   a|SE   TED:x:y/Iterate|ED   q|**   DNI",), ("SE   none|**   HTx",), ("ID   b|**   other",)], "rec string")
    got = [tuple(x) for x in df.select(cu.rewrite_seed_source("rec", "AF"), cu.without_tag("rec", "ED"), cu.is_frozen("rec")).collect()]
    assert got == [
        ("ID   a|SE   AF:x:y|ED   q|**   DNI", "ID   a|SE   TED:x:y/Iterate|**   DNI", True),
        ("SE   none|**   HTx", "SE   none|**   HTx", True),
        ("ID   b|**   other", "ID   b|**   other", False),
    ]


def test_truth_lines_of_odd_form(spark):
    rows = tx.by_delimiter(spark.createDataFrame([("a\t\t-3",), ("a\tb",), ("#c\td\te",), ("\tx\t 4 ",)], "line string"), {"k": "string", "v": "string", "n": "bigint"}, needed=())
    assert [(x["k"], x["v"], x["n"]) for x in rows.orderBy(F.col("n")).collect()] == [("a", "", -3), ("", "x", 4)]
