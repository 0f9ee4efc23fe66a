import random

import numpy as np

from foldloom.operators.greedy import first_for_both_keys, greedy_picks
from foldloom.operators.partition import best_segments, fiedler
from foldloom.operators.structure import components


def test_greedy_picks(spark):
    r = random.Random(3)
    nodes = [(g, k, r.randint(0, 5)) for g in range(3) for k in range(25)]
    conflicts = [(g, r.randint(0, 24), r.randint(0, 24)) for g in range(3) for _ in range(40)]
    got = {(x["g"], x["n"]): x["head"] for x in greedy_picks(spark.createDataFrame(nodes, "g int, n int, r int"), spark.createDataFrame(conflicts, "g int, a int, b int"), "g", "n", "r").collect()}
    want = {}
    for g in range(3):
        picked = []
        for _, k, _ in sorted((x for x in nodes if x[0] == g), key=lambda x: (x[2], x[1])):
            by = [p for p in picked if (g, p, k) in conflicts or (g, k, p) in conflicts]
            want[g, k] = by[0] if by else k
            if not by:
                picked.append(k)
    assert got == want


def block_edges(spark):
    rows = [("p", i, j, 1.0) for a, b in ((1, 20), (21, 40)) for i in range(a, b) for j in range(i + 1, b + 1)] + [("p", 20, 21, 0.1)]
    return spark.createDataFrame(rows, "prot string, i int, j int, w double")


def test_fiedler_parts_blocks(spark):
    values = {x["idx"]: x["value"] for x in fiedler(block_edges(spark)).collect()}
    assert len(values) == 40 and values[1] > 0
    assert {np.sign(v) for k, v in values.items() if k <= 20} == {1} and {np.sign(v) for k, v in values.items() if k > 20} == {-1}


def test_best_segments(spark):
    lengths = spark.createDataFrame([("p", 40), ("q", 30)], "prot string, n int")
    got = sorted((x["prot"], x["seg_s"], x["seg_e"]) for x in best_segments(block_edges(spark), lengths, [0.0, 1.0], 10).collect())
    assert got == [("p", 1, 20), ("p", 21, 40), ("q", 1, 30)]


def test_first_for_both_keys(spark):
    r = random.Random(9)
    rows = [(k, r.randint(0, 15), r.randint(0, 15), r.randint(0, 3)) for k in range(120)]
    got = {x["p"] for x in first_for_both_keys(spark.createDataFrame(rows, "p int, a int, b int, r int"), "p", "a", "b", "r").collect()}
    used, want = set(), set()
    for p, a, b, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        if not {a, b} & used:
            want.add(p)
            used |= {a, b}
    assert got == want


def test_components(spark):
    rows = [(g, k, k + 1) for g in range(2) for k in range(40) if k % 13]
    got = {(x["g"], x["node"]): x["first"] for x in components(spark.createDataFrame(rows, "g int, a int, b int"), "g", "a", "b").collect()}
    want, first = {}, None
    for g in range(2):
        for k in range(1, 41):
            first = k if (k - 1) % 13 == 0 else first
            if (g, k - 1, k) in rows or (g, k, k + 1) in rows:
                want[g, k] = first
    assert got == want
