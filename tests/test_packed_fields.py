import pytest

import foldloom.operators.packed_fields as pf
from foldloom.operators.packed_fields import fit_dictionary, segments, unpack, unpack_ranges

CASES = {
    "11-41_290-389": [(1, 11, 41), (2, 290, 389)],
    '"2,576-2,683", "2,690-2,700"': [(1, 2576, 2683), (2, 2690, 2700)],
    '"981-1,059"': [(1, 981, 1059)],
    "44-87,131-257": [(1, 44, 87), (2, 131, 257)],
    "'51-89'_'NA'": [(1, 51, 89)],
    "NA,,27-114": [(2, 27, 114)],
    "?_C-term_56-117": [(3, 56, 117)],
    "46..137|155..290": [(1, 46, 137), (2, 155, 290)],
    "39 to 157, 202 to 338": [(1, 39, 157), (2, 202, 338)],
    "9 - 30 40 - 50": [(1, 9, 30), (2, 40, 50)],
    "5−9 and 12–19": [(1, 5, 9), (2, 12, 19)],
    "(13-34_79-232 )": [(1, 13, 34), (2, 79, 232)],
    "7-156__216-__350-479": [(1, 7, 156), (3, 350, 479)],
    "x-33_-12;1-2": [(3, 1, 2)],
    "odd word;1-2": [(3, 1, 2)],
    "12": [],
    "": [],
    "none": [],
    "[]": [],
    None: [],
    "A:12-40,B:50-60": [(1, 12, 40), (2, 50, 60)],
    "12→40|50→60; 70->80": [(1, 12, 40), (2, 50, 60), (3, 70, 80)],
    "12 bis 40, 50...60": [(1, 12, 40), (2, 50, 60)],
    "A:B,x:5,C:9": [],
    "1-9223372036854775807_2-9223372036854775808_3-4": [(1, 1, 9223372036854775807), (3, 3, 4)],
    "1234567890123456789012-5_3-4": [(2, 3, 4)],
}


@pytest.mark.parametrize("text", CASES, ids=repr)
def test_segments(text):
    assert segments(text) == CASES[text]


def test_long_field():
    text = "_".join(f"{k}-{k + 3}" for k in range(1, 40_001, 4))
    assert segments(text) == [(k, 4 * k - 3, 4 * k) for k in range(1, 10_001)]


def test_unpack(spark):
    df = spark.createDataFrame([(1, "1-2_4-5", 9), (1, "1-2_4-5", 9), (2, None, 9), (None, "7-8", 9), (3, "-", 9)], "k bigint, c string, seg_no int")
    got = sorted(map(tuple, unpack_ranges(df, "k", "c").collect()), key=str)
    assert got == sorted([(1, 1, 1, 2), (1, 2, 4, 5)] * 2 + [(None, 1, 7, 8)], key=str)
    assert unpack_ranges(df.limit(0), "k", "c").count() == 0


FIELDS = [
    ("Smith, John; Doe, Jane", [("Smith, John", True), ("Doe, Jane", True)]),
    ("Doe, Jane", [("Doe, Jane", True)]),
    ("Smith, Jane|red ,Doe, Jane", [("Smith", False), ("Jane", False), ("red", False), ("Doe, Jane", True)]),
    ("New York;; Washington, D.C. ;x", [("New York", False), ("Washington, D.C.", True), ("x", False)]),
    ('"a; b", "say ""no""",c', [("a; b", True), ('say "no"', True), ("c", False)]),
    ("Washington, D.C.ish, Doe, Jane", [("Washington", False), ("D.C.ish", False), ("Doe, Jane", True)]),
    ("Doe, Jane, Jr; Doe, Jane", [("Doe, Jane, Jr", True), ("Doe, Jane", True)]),
    (" ; , ", []),
    ("  ", []),
    (None, []),
    ("blank" + " " * 50_000 + "run", [("blank" + " " * 50_000 + "run", False)]),
]


@pytest.mark.parametrize("most", [1 << 20, 0], ids=["broadcast", "joined"])
def test_unpack_by_dictionary(spark, most):
    known = spark.createDataFrame([(x,) for x in ("Smith, John", "Doe, Jane", "Doe, Jane", "Doe, Jane, Jr", "Washington, D.C.", "plain", None, "")], "value string")
    df = spark.createDataFrame([(f"r{k}", t, "clash") for k, (t, _) in enumerate(FIELDS)] + [("r1", "Doe, Jane", "clash")], "row string, v string, value string")
    got = {}
    for x in unpack(df, "row", "v", known, max_dictionary=most).collect():
        got.setdefault(x["row_id"], []).append((x["place"], x["value"], x["known"]))
    want = {f"r{k}": [(p, *v) for p, v in enumerate(values, 1)] for k, (_, values) in enumerate(FIELDS) if values}
    want["r1"] = want["r1"] * 2
    assert {k: sorted(v) for k, v in got.items()} == want
    assert unpack(df.limit(0), "row", "v", known, max_dictionary=most).count() == 0
    plain = unpack(df.where("row = 'r0'"), "row", "v", known.limit(0), max_dictionary=most)
    assert [x["value"] for x in plain.orderBy("place").collect()] == ["Smith", "John", "Doe", "Jane"]


def test_fitted_dictionary(spark):
    fields = ["Smith, John", "Smith, John", "red, blue", "red, blue", "red", "blue; green", "red; Smith, John", "once, only", None, " "]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(fields)], "id int, tags string")
    assert {x["value"] for x in fit_dictionary(df, "tags").collect()} == set()  # Smith and John stand in another field too, as a whole
    assert {x["value"] for x in fit_dictionary(df.where("id <> 6"), "tags").collect()} == {"Smith, John"}


def test_cover_prefers_known_and_long():
    known = pf.automaton([("a,b", 1), ("b,c", 1), ("a,b,c", 1)])
    import re

    assert pf.values_of("a,b,c,d", known, re.compile(",")) == [("a,b,c", True), ("d", False)]
