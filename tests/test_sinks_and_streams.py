import gzip

from foldloom.sources import writers as w
from foldloom.sources.lines import fasta, read_lines, read_records
from foldloom.streaming.incremental import current, follow_hits

SCHEMA = "hit_id bigint, family string, evalue double"


def test_stream_keeps_statistics(spark, tmp_path):
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    first = [(1, "a", 1e-5), (2, "a", 1e-12), (3, "b", None), (4, None, 0.1)]
    second = [(5, "a", 1e-12), (6, "b", 0.5)]
    assert current(spark, out).count() == 0
    for rows in (first, second, []):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        follow_hits(spark, landing, SCHEMA, out, state)
    got = {r["family"]: (r["n_hits"], r["best_evalue"], r["best_hit"], r["n_strong"]) for r in current(spark, out).collect()}
    assert got == {"a": (3, 1e-12, 2, 2), "b": (1, 0.5, 6, 0)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.25, "ACDEFG"), ("b", 2, 0.5, "AC")], "id string, n int, v double, seq string")
    w.write_table(df, str(tmp_path / "t"), {"v": 4})
    rows = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()
    assert sorted((r["id"], r["v"]) for r in rows) == [("a", "0.2500"), ("b", "0.5000")]
    w.write_lines_by_key(df, str(tmp_path / "k"), "id", "seq", "n")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "k/id=a")).collect()] == ["ACDEFG"]
    w.write_fasta(df, str(tmp_path / "f"), "id", "seq")
    assert sorted((r["id"], r["sequence"]) for r in fasta(read_records(spark, str(tmp_path / "f"), ">")).collect()) == [("a", "ACDEFG"), ("b", "AC")]
    assert df.select(w.fasta_record(df["id"], df["seq"], 4).alias("x")).first()["x"] == ">a\nACDE\nFG"
    w.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    w.write_index(df, str(tmp_path / "i"), "id", 8)
    assert [r["n"] for r in w.read_index(spark, str(tmp_path / "i"), "id", ["b"], 8).collect()] == [2]


def test_compressed_lines(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.write("a\t1\nb\t2\n")
    assert [r["line"] for r in read_lines(spark, str(tmp_path / "x.tsv.gz")).collect()] == ["a\t1", "b\t2"]
