import random
from collections import Counter
from itertools import combinations

import pytest

from foldloom.llm.components import group_linked
from foldloom.llm import cooccurrence
from foldloom.llm.cooccurrence import count_pairs


def brute_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


@pytest.fixture(params=["plain", "skewed"])
def joins(spark, request):
    """Joins as they come, and with every larger partition split as skewed."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k) for k in confs}
    if request.param == "skewed":
        for k, v in confs.items():
            spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_groups(spark, joins, kind):
    r = random.Random(1)
    name = lambda k: f"n{k:04d}"
    pairs = {
        "random": [(name(r.randint(0, 150)), name(r.randint(0, 150))) for _ in range(90)] + [("only", None), (None, "other"), (None, None), ("self", "self")],
        "chain": [(name(k), name(k + 1)) for k in range(60)],
        "star": [("hub", name(k)) for k in range(80)] + [(name(3), "hub")] * 5,
        "empty": [],
    }[kind]
    df = spark.createDataFrame([(*p, "x") for p in pairs], "a string, b string, record string")
    rows = group_linked(df, "a", "b").collect()
    assert len(rows) == len({x["record"] for x in rows})
    assert {x["record"]: x["group_id"] for x in rows} == brute_groups(pairs)


@pytest.mark.parametrize("block", [3, 512])
@pytest.mark.parametrize("least", [(1, 0.0), (2, 1.2)])
def test_pairs(spark, joins, block, least):
    r = random.Random(2)
    rows = [(r.choice(["hot", *map(str, range(25)), None]), r.choice(["a", "b", *(f"i{k}" for k in range(12)), None])) for _ in range(500)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "k string, v string, n string")
    baskets = {}
    for k, v in rows:
        if k and v:
            baskets.setdefault(k, set()).add(v)
    single = Counter(v for b in baskets.values() for v in b)
    pair = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    n = len(baskets)
    want = {p: (m, single[p[0]], single[p[1]], n) for p, m in pair.items() if m >= least[0] and m * n >= least[1] * single[p[0]] * single[p[1]]}
    got = {(x["item_a"], x["item_b"]): (x["n_ab"], x["n_a"], x["n_b"], x["n"]) for x in count_pairs(df, "k", "v", *least, block=block).collect()}
    assert got == want


def test_odds_and_empty(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("3", "c")], "k string, v string")
    x = count_pairs(df, "k", "v").first()
    assert (x["ratio"], round(x["odds_ratio"], 6)) == (1 * 3 / (2 * 1), round(1.5 * 1.5 / (1.5 * 0.5), 6))
    assert count_pairs(df.limit(0), "k", "v").count() == 0


def test_too_many_items(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "CODE_BITS", 1)
    with pytest.raises(ValueError):
        count_pairs(spark.createDataFrame([("1", x) for x in "abc"], "k string, v string"), "k", "v")
