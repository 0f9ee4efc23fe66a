import random

import pytest

from foldloom.operators.heavy_keys import figures_by_key
from foldloom.operators.intervals import overlap_join, without_overlap
from foldloom.operators.ordered import next_in_order, number_rows
from foldloom.operators.periods import periods_and_gaps


def test_number_rows_and_next(spark):
    values = random.Random(1).sample(range(10_000), 500)
    numbered = number_rows(spark.createDataFrame([(v,) for v in values], "v bigint"), ["v"], "rank")
    got = {r["v"]: r["rank"] for r in numbered.collect()}
    assert got == {v: k for k, v in enumerate(sorted(values))}
    following = {r["rank"]: r["next_v"] for r in next_in_order(numbered, "rank", ["v"], chunk=7).collect()}
    assert following == {k: v for k, v in enumerate([*sorted(values)[1:], None])}
    sparse = numbered.where("rank % 50 < 3")  # whole chunks without a row
    kept = [(k, v) for k, v in enumerate(sorted(values)) if k % 50 < 3]
    following = {r["rank"]: r["next_v"] for r in next_in_order(sparse, "rank", ["v"], chunk=3).collect()}
    assert following == {a[0]: b[1] for a, b in zip(kept, [*kept[1:], (None, None)])}
    assert number_rows(spark.createDataFrame([], "v bigint"), ["v"], "rank").count() == 0


def brute_periods(rows):
    out, by = [], {}
    for i, s, e in rows:
        if None not in (i, s, e) and s <= e:
            by.setdefault(i, []).append((s, e))
    for i, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(i, "period", s, e) for s, e in merged]
        out += [(i, "gap", a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_periods(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c", "hot", "hot", "hot", None]), r.choice([None, *[r.randint(1, 300)] * 9]), r.randint(1, 320), 0, "x") for _ in range(400)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "id string, s bigint, e bigint, rank int, stretch string")
    assert sorted(map(tuple, periods_and_gaps(df, "id", "s", "e").collect())) == brute_periods([x[:3] for x in rows])
    assert periods_and_gaps(df.limit(0), "id", "s", "e").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_figures_by_key(spark, seed):
    r = random.Random(seed)
    rows = [
        (k, r.choice(["hot"] * 6 + ["a", "b", None]), r.choice(["p%d" % r.randint(1, 30), None]), r.choice([None, float("nan"), 0.0, 1.5, r.random()]), "x")
        for k in range(3000)
    ]
    df = spark.createDataFrame(rows, "region_id bigint, family string, id string, evalue double, part string").repartition(5)
    want = {}
    for k, f, i, v, _ in rows:
        if f:
            x = want.setdefault(f, [0, set(), None])
            x[0] += 1
            x[1] |= {i} - {None}
            if v is not None and v == v:
                x[2] = min(x[2] or (v, k), (v, k))
    want = {f: (n, len(i), b[1] if b else 0) for f, (n, i, b) in want.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {x["key"]: (x["n_rows"], x["n_items"], x["best_row_id"]) for x in figures_by_key(df, "family", "id", "evalue", "region_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert figures_by_key(df.limit(0), "family", "id", "evalue", "region_id").count() == 0


def test_overlap_join(spark):
    r = random.Random(3)
    a = [(r.choice(["p", "q", None]), k, r.randint(1, 2000), r.randint(1, 2200)) for k in range(200)]
    b = [(r.choice(["p", "q", "z"]), k, r.randint(1, 2000), r.randint(1, 2200)) for k in range(200)]
    left = spark.createDataFrame(a, "acc string, l bigint, ls bigint, le bigint")
    right = spark.createDataFrame(b, "acc string, r bigint, rs bigint, re bigint")
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    got = sorted((x["l"], x["r"]) for x in overlap_join(left, right, "acc", "ls", "le", "rs", "re", width=64).collect())
    assert got == want
    free = {x["l"] for x in without_overlap(left.where("ls <= le and acc is not null"), right, "acc", ["l"], "ls", "le", "rs", "re").collect()}
    assert free == {x[1] for x in a if x[0] and x[2] <= x[3]} - {p[0] for p in want}
