import random
from collections import defaultdict
from itertools import combinations
from math import exp

import pytest

import __spark_entry__ as entry
from foldloom.operators.greedy import used_once


def pass_once(pairs):
    """The pairs that a pass in order keeps if each key is used once."""
    used, kept = set(), []
    for p in sorted(pairs):
        if not {p[0], p[1]} & used:
            kept.append(p)
            used |= {p[0], p[1]}
    return kept


def test_family_pairs_once(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randint(1, 9), r.randint(1, 4), r.randint(1, 2), r.randint(1, 3), float(r.randint(0, 60)), float(r.randint(1, 40)), r.choice([0.0, 5.0, 10.0]), "O", "A") for _ in range(400)]
    rows += rows[:40] + [(*x[:6], 7.0, *x[7:]) for x in rows[:40]] + [(1, None, 1, 1, 5.0, 5.0, 0.1, "O", "A"), (None, 1, 1, 2, 5.0, 5.0, None, "O", "A"), (3, 1, 70000, 1, 5.0, 5.0, 0.1, "O", "A"), (3, 1, 3, 2, 8.0, 70000.0, 0.1, "O", "A")]
    names = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_suppkey bigint, l_extendedprice double, l_quantity double, l_discount double, l_linestatus string, l_returnflag string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    scores = defaultdict(list)
    for o, acc, ln, fam, price, quantity, discount, _, _ in rows:
        s = int(price) % 400 + 1
        if acc:
            scores[acc, (float("inf") if o is None else o, ln, fam, s, s + int(quantity) + 19)].append(None if discount is None else exp(-discount * 0.01))
    pairs = defaultdict(list)
    for (p, a), (q, b) in combinations(sorted(scores), 2):
        (_, _, f, s, e), (_, _, g, t, u) = a, b
        if p == q and f != g and s <= u and t <= e and (2 * t < s + e < 2 * u or 2 * s < t + u < 2 * e):
            pairs[p].append(((a, g), (b, f)))
    want = defaultdict(lambda: [0, 0.0])
    for p, found in pairs.items():
        for (a, g), (b, f) in pass_once(found):
            x, y = ([w for w in scores[p, k] if w is not None] for k in (a, b))
            want[min(f, g), max(f, g)][0] += 1
            want[min(f, g), max(f, g)][1] += min(x) * min(y) if x and y else 0
    df = entry.queries()["a05_family_pairs_once"](spark, str(tmp_path))
    got = {(x["fam_1"], x["fam_2"]): (x["n_common"], x["sum_score"]) for x in df.collect()}
    assert got == {k: (n, pytest.approx(s, abs=1e-3)) for k, (n, s) in want.items()} and len(got) == 3
    assert all(f.startswith(f"file://{tmp_path}/") for f in df.inputFiles())  # no table of pairs is written


def test_used_once_over_batches(spark):
    r = random.Random(5)
    rows = list({(r.randint(0, 3), r.randint(0, 30), r.randint(31, 60)) for _ in range(400)})
    df = spark.createDataFrame(rows, "g int, a int, b int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(x) for x in used_once(df, ["g"], "a", "b", ["g", "a", "b"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(g, *p) for g in range(4) for p in pass_once([x[1:] for x in rows if x[0] == g])}
