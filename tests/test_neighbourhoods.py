import random
from collections import deque

import pytest

import __spark_entry__ as entry
from foldloom.operators import networks


def around(links, start, hops):
    """By steps from the start; nulls are reached, but lead nowhere."""
    hop, open_ = {start: 0}, deque([start])
    while open_:
        x = open_.popleft()
        if x is not None and hop[x] < hops:
            for y in {q for p, q in links if p == x} | {p for p, q in links if q == x}:
                if y not in hop:
                    hop[y] = hop[x] + 1
                    open_.append(y)
    return hop


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_neighbourhoods_by_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(networks, "BLOCK_LINKS", 40)
    monkeypatch.setattr(networks, "CHUNK_PATHS", 15)
    r = random.Random(7)
    name = lambda k: k if k is None or kind == "bigint" else f"n{k}"
    links = [(r.randint(1, 60), r.randint(1, 60)) for _ in range(90)] + [(5, 5), (7, 7), (3, None), (None, 9), (None, None), (1, 2), (2, 1)]
    links = [(name(p), name(q)) for p, q in links]
    starts = [name(k) for k in (1, 1, 3, 5, 9, 12, 30, 41, 99, None)]
    edges, begin = spark.createDataFrame(links, f"p {kind}, q {kind}"), spark.createDataFrame([(s,) for s in starts], f"id {kind}")
    for hops in range(4):
        got = networks.neighbourhoods(edges, "p", "q", begin, "id", hops).collect()
        want = {(s, x, h) for s in set(starts) - {None} for x, h in around(links, s, hops).items()}
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_neighbourhoods_write_no_pairs(spark, monkeypatch):
    written, cut = [], networks.cut
    monkeypatch.setattr(networks, "cut", lambda df, name: (written.append((name, got := cut(df, name))), got)[1])
    edges = spark.range(2000).selectExpr("id as p", "-1 - id % 2 as q")
    got = networks.neighbourhoods(edges, "p", "q", edges, "p", 2)
    assert got.count() == 2000 * (1 + 1 + 999)
    assert max(x.count() for _, x in written) <= 2002  # lists of neighbours, and blocks of them
    assert "hops" not in dict(written)


def test_neighbourhood_of_every_protein(spark, tmp_path):
    rows = [(1, 5, 900.0), (2, 5, 950.0), (2, 6, 500.0), (3, 7, 100.0)]
    spark.createDataFrame([(*r, 1) for r in rows], "l_suppkey bigint, l_partkey bigint, l_extendedprice double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(x["start"], x["node"]): x["hop"] for x in entry.queries()["x02_neighbourhood_all"](spark, str(tmp_path)).collect()}
    m = 1000000
    want = {(1, m + 5): 1, (1, 2): 2, (2, m + 5): 1, (2, m + 6): 1, (2, 1): 2, (m + 5, 1): 1, (m + 5, 2): 1, (m + 5, m + 6): 2, (m + 6, 2): 1, (m + 6, m + 5): 2}
    assert got == want | {(k, k): 0 for k in (1, 2, 3, m + 5, m + 6, m + 7)}
