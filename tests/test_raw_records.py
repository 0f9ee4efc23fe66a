import pytest

from foldloom.operators.raw_records import alignment_records, region_records

REGION = {
    "A1,PF00001,1,9,1e-5,text": None,
    ' A1 ,PF00001, 1 ,9\t,.5,"a ""b"", c"\r': None,
    '"A1","PF00001","1","9","1.","two\nlines"': None,
    "A1,PF00001,1,9,0,": None,
    "A1,PF00001,1,9,1e-5": "5 fields instead of 6",
    "A1,PF00001,1,9,1e-5,a,b": "7 fields instead of 6",
    'A1,PF00001,1,9,1e-5,"open': "broken quoting",
    'A1,PF00001,1,9,1e-5,a "b"': "broken quoting",
    'A1,PF00001,1,9,1e-5, "b"': "broken quoting",
    "A1,PF00001,1,9,1e-5,two\nlines": "broken quoting",
    ",PF00001,1,9,1e-5,a": "empty id",
    "A1,PF0001,1,9,1e-5,a": "family isn't an accession",
    'A1," PF00001",1,9,1e-5,a': "family isn't an accession",
    "A1,PF00001,x,9,1e-5,a": "start isn't a whole number",
    "A1,PF00001,1,9999999999999999999,1e-5,a": "end isn't a whole number",
    "A1,PF00001,1000000000000000000,9223372036854775807,1e-5,a": None,
    "A1,PF00001,1,0009223372036854775807,1e-5,a": None,
    "A1,PF00001,1,9223372036854775808,1e-5,a": "end isn't a whole number",
    "A1,PF00001,0,9,1e-5,a": "start under 1",
    "A1,PF00001,10,9,1e-5,a": "start behind end",
    "A1,PF00001,1,9,-1,a": "E-value isn't a finite unsigned number",
    "A1,PF00001,1,9,1e999,a": "E-value isn't a finite unsigned number",
    "A1,PF00001,1,9,nan,a": "E-value isn't a finite unsigned number",
}
ALIGNMENT = {
    "X1AAA2.1/3-5  A-c.D": None,
    '"X1AAA2.1/3-5"\tAC-D  \r': None,
    "X1AAA2.1/3-5 ACD EF": "3 fields instead of 2",
    "X1AAA2.1/3-5": "1 field instead of 2",
    '"X1AAA2.1/3-5 ACD': "broken quoting",
    'X1AAA2.1/3-5 "ACD"': "broken quoting",
    "X1AAA.1/3-5 ACD": "full id isn't accession.version/start-end",
    "X1AAA2.0/3-5 ACD": "version under 1",
    "X1AAA2.1/0-2 ACD": "start under 1",
    "X1AAA2.1/5-3 ACD": "start behind end",
    "X1AAA2.1/3-5 AC1": "sequence holds more than letters, - and .",
    "X1AAA2.1/3-5 AC-": "letters don't fill start to end",
}
SKIPPED = ["", "  \t", "#x", "//", "// \r", None, "\r"]


@pytest.mark.parametrize("f, cases", [(region_records, REGION), (alignment_records, ALIGNMENT)])
def test_reasons(spark, f, cases):
    lines = list(cases)
    rows = [(k, x, "clash", "clash") for k, x in enumerate([*lines, *SKIPPED, *lines])]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string, state string, reason string")
    got = {r["line_id"]: r for r in f(df).collect()}
    n = len(lines)
    assert set(got) == {*range(n), *range(n + len(SKIPPED), 2 * n + len(SKIPPED))}
    for k, line in enumerate(lines):
        for again in (k, k + n + len(SKIPPED)):
            assert (got[again]["reason"], got[again]["raw_line"]) == (cases[line], line)
            assert got[again]["state"] == ("rejected" if cases[line] else "valid")


def test_typed_values(spark):
    long = "x" * 200_000
    df = spark.createDataFrame([(1, f'"A,1",PF00001, 7 ,"8",2.5E-3,"{long} ""q"""')], "line_id bigint, raw_line string")
    r = region_records(df).first()
    assert (r["id"], r["family"], r["seq_start"], r["seq_end"], r["evalue"], r["description"]) == ("A,1", "PF00001", 7, 8, 2.5e-3, long + ' "q"')
    a = alignment_records(spark.createDataFrame([(1, '"X1AAA2AAA3.4/3-5" a-C.d')], "line_id bigint, raw_line string")).first()
    assert (a["accession"], a["version"], a["seq_start"], a["seq_end"], a["aligned"]) == ("X1AAA2AAA3", 4, 3, 5, "a-C.d")


def test_records_come_out_unchanged(spark):
    """Also where they hold characters that serve as marks elsewhere."""
    odd = "\x1f\ue000 de\x1fsc \ue001"
    df = spark.createDataFrame([(1, f'A1,PF00001,1000000000000000000,1000000000000000001,1,"{odd}"'), (2, f'"{odd}",PF00001,1,2,1,'), (3, f"A1,PF00001,1,2,1,x{odd}y")], "line_id bigint, raw_line string")
    got = {r["line_id"]: r for r in region_records(df).collect()}
    assert (got[1]["description"], got[2]["id"], got[3]["description"]) == (odd, odd, f"x{odd}y")
    assert (got[1]["seq_start"], got[1]["seq_end"]) == (10**18, 10**18 + 1)


def test_empty_table(spark):
    assert region_records(spark.createDataFrame([], "line_id bigint, raw_line string")).count() == 0
