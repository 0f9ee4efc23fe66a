import random
from itertools import combinations

import numpy as np
import pytest

from foldloom.operators.merging import MERGES, consolidated, domain_pairs, merged_domains
from foldloom.operators.partition import _second_vector, best_segments, bisected, fiedler
from foldloom.operators.voronoi import best_partition, chain_score, compact_score

EDGES = "prot string, i int, j int, w double"


def planted(blocks, prot="p", bridge=0.05):
    """Blocks of residues in full contact, one after the other, weakly joined."""
    rows = [(prot, i, j, 1.0) for a, b in blocks for i in range(a, b + 1) for j in range(i + 1, b + 1)]
    return rows + [(prot, a[1], b[0], bridge) for a, b in zip(blocks, blocks[1:])]


@pytest.mark.parametrize("n", [2, 3, 40, 200])
def test_second_vector_equals_the_dense_one(n):
    rng = np.random.default_rng(n)
    a, b = np.triu_indices(n, 1)
    keep = rng.random(len(a)) < min(1, 12 / n)
    keep |= b == a + 1
    a, b = a[keep], b[keep]
    w = rng.random(len(a)) + 0.01
    dense = np.zeros((n, n))
    dense[a, b] = dense[b, a] = w
    d = 1 / np.sqrt(dense.sum(axis=1))
    values, vectors = np.linalg.eigh(np.eye(n) - d[:, None] * dense * d)
    value, v = _second_vector(n, a, b, w)
    assert abs(value - values[1]) < 1e-8
    assert min(np.abs(v - vectors[:, 1]).max(), np.abs(v + vectors[:, 1]).max()) < 1e-6


def test_long_chain_in_little_memory(spark):
    """6,000 residues: a dense matrix would take 288 MB, several of them more."""
    rows = [("p", i, i + k, 1.0) for i in range(1, 6001) for k in (1, 2, 3) if i + k <= 6000 and not (i <= 3000 < i + k)] + [("p", 3000, 3001, 0.01)]
    values = {x["idx"]: x["value"] for x in fiedler(spark.createDataFrame(rows, EDGES)).collect()}
    assert all((values[k] > 0) == (k <= 3000) for k in range(1, 6001))


def test_bisection_finds_planted_domains(spark):
    blocks = [(1, 40), (41, 90), (91, 125)]
    found = bisected(spark.createDataFrame(planted(blocks) + planted([(1, 50)], "q"), EDGES), 30).collect()
    got = {(x["prot"], x["idx"]): x["dom"] for x in found}
    assert got == {("p", k): d for d, (a, b) in enumerate(blocks, 1) for k in range(a, b + 1)} | {("q", k): 1 for k in range(1, 51)}
    once = bisected(spark.createDataFrame(planted(blocks), EDGES), 30, depth=1).collect()
    assert len({x["dom"] for x in once}) == 2
    assert {x["dom"] for x in bisected(spark.createDataFrame(planted(blocks), EDGES), 60).collect()} <= {1, 2}
    assert bisected(spark.createDataFrame([], EDGES)).count() == 0


def test_segments_by_candidates_and_another_score(spark):
    edges = spark.createDataFrame(planted([(1, 20), (21, 40)]), EDGES)
    lengths = spark.createDataFrame([("p", 40), ("q", 5)], "prot string, n int")
    segs = lambda **x: sorted((y["seg_s"], y["seg_e"]) for y in best_segments(edges, lengths, [0.0, 1.0], 10, **x).collect())
    assert segs() == [(1, 20), (21, 40)]
    cuts = spark.createDataFrame([("p", 15), ("p", 19), ("p", 26)], "prot string, idx int")
    assert segs(candidates=cuts) in ([(1, 14), (15, 40)], [(1, 25), (26, 40)])
    assert segs(candidates=cuts.limit(0)) == [(1, 40)]
    assert segs(worth=lambda inside, size, total, n: inside * 0.0 + (size == 10)) != segs()


def brute_segments(n, edges, penalty, min_size):
    total = sum(w for *_, w in edges)
    worth = lambda a, b: sum(w for i, j, w in edges if a <= i and j <= b) - total * ((b - a + 1) / n) ** 2
    best = (-1e9, None)
    for k in range(0, n // min_size):
        for cuts in combinations(range(1, n), k):
            segs = list(zip([1, *[c + 1 for c in cuts]], [*cuts, n]))
            if all(b - a + 1 >= min_size for a, b in segs):
                best = max(best, (sum(worth(a, b) - penalty for a, b in segs), segs), key=lambda x: x[0])
    return best[1]


@pytest.mark.parametrize("seed", range(3))
def test_segments_equal_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(i, j, round(r.random(), 3)) for i in range(1, 13) for j in range(i + 1, 13) if r.random() < 0.4]
    df = spark.createDataFrame([("p", *x) for x in edges], EDGES)
    lengths = spark.createDataFrame([("p", 12)], "prot string, n int")
    got = sorted((x["seg_s"], x["seg_e"]) for x in best_segments(df, lengths, [0.3], 2).collect())
    assert got == brute_segments(12, edges, 0.3, 2)


def globes(r, centres, size):
    """Residues of compact domains, one after the other along the chain, and their contacts."""
    rows = [("p", 1 + k + size * d, *(c + r.gauss(0, 3) for c in centre), 90.0) for d, centre in enumerate(centres) for k in range(size)]
    near = [("p", a[1], b[1], 1.0) for a in rows for b in rows if a[1] < b[1] and sum((a[k] - b[k]) ** 2 for k in (2, 3, 4)) < 100]
    return rows, near


@pytest.mark.parametrize("climbing, score", [(False, compact_score()), (True, chain_score(min_size=20))], ids=["modularity", "chain"])
def test_search_finds_the_number_of_domains(spark, climbing, score):
    rows, near = globes(random.Random(4), [(0, 0, 0), (40, 0, 0), (0, 45, 10)], 30)
    res = spark.createDataFrame(rows, "prot string, idx int, x double, y double, z double, plddt double")
    run = lambda: {(x["idx"], x["dom"], x["k"]) for x in best_partition(res, spark.createDataFrame(near, EDGES), [1, 2, 3, 4], score, climbing=climbing).collect()}
    found = run()
    assert found == {(k, 1 + (k - 1) // 30, 3) for k in range(1, 91)}
    assert run() == found


def test_merges(spark):
    r = random.Random(2)
    dom = {k: 1 + (k - 1) // 5 for k in range(1, 21)}  # four domains of five; 1 and 2 belong together, 3 and 4 are near in space only
    low = {frozenset((1, 2))}
    errors = [("p", i, j, (3.0 if dom[i] == dom[j] else 4.0 if frozenset((dom[i], dom[j])) in low else 20.0) + r.random()) for i in dom for j in dom if i != j]
    members = spark.createDataFrame([("p", k, d) for k, d in dom.items()], "prot string, idx int, dom int")
    near = spark.createDataFrame([("p", 5, 6, 4.0), ("p", 15, 16, 4.0)], "prot string, i int, j int, d double")
    pairs = domain_pairs(spark.createDataFrame(errors, "prot string, i int, j int, pae double"), members, near)
    sizes = spark.createDataFrame([("p", d, 5) for d in (1, 2, 3, 4)], "prot string, dom int, n int")
    for name in MERGES:
        got = {x["dom"]: x["head"] for x in merged_domains(pairs, sizes, name, 3.0 if name == "boundary_strength" else 8.0).collect()}
        assert got == ({1: 1, 2: 2, 3: 3, 4: 4} if name == "none" else {1: 1, 2: 1, 3: 3, 4: 4}), name
    everything = {x["head"] for x in merged_domains(pairs, sizes, "simple_merge", 100.0).collect()}
    assert everything == {1}
    with pytest.raises(KeyError):
        merged_domains(pairs, sizes, "unknown", 1.0)


def brute_consolidated(ranges):
    ranges = [[s, e, 1] for s, e in sorted(set(ranges))]

    def part(x, y):
        common, small = min(x[1], y[1]) - max(x[0], y[0]), min(x[1] - x[0], y[1] - y[0])
        return common / small if common > 0 and small > 0 else 0.0

    for step in (0.8, 0.5):
        while len(ranges) > 1:
            best, i, j = max(((part(ranges[i], ranges[j]), -i, -j) for i, j in combinations(range(len(ranges)), 2)), key=lambda x: x)
            if best < step or best <= 0:
                break
            x, y = ranges[-i], ranges[-j]
            ranges[-i] = [min(x[0], y[0]), max(x[1], y[1]), x[2] + y[2]]
            del ranges[-j]
    return sorted(map(tuple, ranges))


@pytest.mark.parametrize("seed", range(4))
def test_consolidated_ranges(spark, seed):
    r = random.Random(seed)
    rows = [(k % 2, s, s + r.randint(0, 80)) for k in range(60) for s in [r.randint(1, 400)]]
    df = spark.createDataFrame(rows + rows[:5] + [(0, None, 3)], "prot int, s bigint, e bigint")
    got = {}
    for x in consolidated(df, "prot", "s", "e").collect():
        got.setdefault(x["prot"], []).append((x["seg_s"], x["seg_e"], x["n"]))
    assert {k: sorted(v) for k, v in got.items()} == {p: brute_consolidated([(s, e) for q, s, e in rows if q == p]) for p in (0, 1)}


RES = "prot string, idx int, x double, y double, z double, plddt double"


def test_graph_figures_against_brute_force(spark):
    from foldloom.operators import structure as st

    r = random.Random(11)
    edges = [("p", i, j, round(r.random() + 0.1, 3)) for i in range(1, 16) for j in range(i + 1, 16) if r.random() < 0.35]
    w = {frozenset((i, j)): x for _, i, j, x in edges}
    top, nodes = max(w.values()), range(1, 17)
    near = {n: {m for m in nodes if frozenset((n, m)) in w} for n in nodes}
    want = 0.0
    for n in nodes:
        k = len(near[n])
        share = sum((w[frozenset((n, a))] * w[frozenset((n, b))] * w[frozenset((a, b))]) ** (1 / 3) / top for a, b in combinations(sorted(near[n]), 2) if b in near[a])
        want += 2 * share / (k * (k - 1)) if k > 1 else 0
    res = spark.createDataFrame([("p", n) for n in nodes], "prot string, idx int")
    x = st.mean_clustering(spark.createDataFrame(edges, EDGES), res).first()
    assert abs(x["clustering"] - want / 16) < 1e-9
    assert x["n_triangles"] == sum(b in near[a] and c in near[a] and c in near[b] for a, b, c in combinations(nodes, 3))


def test_largest_dimension(spark):
    from foldloom.operators import structure as st

    r = random.Random(12)
    rows = [("p", k, r.gauss(0, 10), r.gauss(0, 3), r.gauss(0, 1), 90.0) for k in range(1, 80)] + [("q", 1, 0.0, 0.0, 0.0, 90.0)]
    res = spark.createDataFrame(rows, RES)
    members = res.selectExpr("prot", "idx", "idx % 2 as dom")
    got = {(x["prot"], x["dom"]): x["max_dimension"] for x in st.largest_dimension(res, members).collect()}
    for key in got:
        own = [x for x in rows if (x[0], x[1] % 2) == key]
        assert abs(got[key] - max(sum((a[k] - b[k]) ** 2 for k in (2, 3, 4)) ** 0.5 for a in own for b in own)) < 1e-9
    assert set(got) == {("p", 0), ("p", 1), ("q", 1)}


def test_small_domains_join_their_neighbours(spark):
    from foldloom.operators import structure as st

    members = spark.createDataFrame([("p", k, 1 if k <= 10 else 2 if k <= 12 else 3 if k <= 30 else 4) for k in range(1, 32)], "prot string, idx int, dom int")
    edges = spark.createDataFrame([("p", 10, 11, 1.0), ("p", 12, 13, 1.0), ("p", 12, 14, 1.0)], EDGES)
    got = {x["idx"]: x["dom"] for x in st.with_small_merged(edges, members, 5).collect()}
    assert {k: d for k, d in got.items() if k in (5, 11, 12, 20, 31)} == {5: 1, 11: 3, 12: 3, 20: 3, 31: 4}  # 4 has no contact


def test_trimmed_seeds_and_spacing(spark):
    from foldloom.operators import structure as st
    from foldloom.operators.islands import spaced

    res = spark.createDataFrame([("p", k, 4.0 * k, 0.0, 0.0, 90.0 if 5 <= k <= 20 else 30.0) for k in range(1, 31)], RES)
    domains = spark.createDataFrame([("p", 1, 1, 15), ("p", 2, 16, 30), ("p", 3, 22, 30)], "prot string, dom int, s int, e int")
    assert {(x["dom"], x["s"], x["e"]) for x in st.trimmed_to_structured(res, domains).collect()} == {(1, 5, 15), (2, 16, 20)}
    assert {x["idx"] for x in st.seeds_by(res, "grid", spacing=20.0).collect()} <= set(range(5, 21))
    chosen = sorted(x["idx"] for x in st.seeds_by(res, "random", n=3).collect())
    assert 2 <= len(chosen) <= 3 and all(b - a >= 4 for a, b in zip(chosen, chosen[1:]))
    assert chosen == sorted(x["idx"] for x in st.seeds_by(res, "random", n=3).collect())
    with pytest.raises(KeyError):
        st.seeds_by(res, "unknown")
    rows = spark.createDataFrame([("p", k) for k in (3, 3, 5, 12, 13, 30)] + [("q", 1)], "prot string, idx int")
    assert sorted(map(tuple, spaced(rows, ["prot"], "idx", 9).collect())) == [("p", 3), ("p", 12), ("p", 30), ("q", 1)]


def test_identity_ladder(spark):
    from foldloom.operators.sequences import identity_ladder

    rows = [(1, "f", "ACDEFGHIKLMNPQRSTVWY"), (2, "f", "ACDEFGHIKLMNPQRSTVWA"), (3, "g", "AAAA"), (4, "h", "CCCCCCCCCC"), (5, "h", "DDDDDDDDDD"), (6, "i", "EEEE"), (7, "i", "EEEE")]
    got = {x["id"]: (x["representative"], x["identity"]) for x in identity_ladder(spark.createDataFrame(rows, "id int, family string, aln string"), "family", "id", "aln").collect()}
    assert got == {1: (1, 1.0), 2: (2, 1.0), 3: (3, 0.8), 4: (4, 0.8), 5: (5, 0.8), 6: (6, 1.0), 7: (6, 1.0)}


def test_stages_find_planted_domains(spark):
    """Two compact domains joined by a disordered linker, with a disordered tail."""
    from foldloom.operators import structure as st

    r = random.Random(7)
    rows = []
    for k in range(1, 131):
        d = 1 if k <= 45 else 2 if 61 <= k <= 110 else 0
        at = [r.uniform(-9, 9) + (0, 0, 60)[d] for _ in range(3)] if d else [200.0 + 40 * k, 5.0 * k, 0.0]
        rows.append(("p", k, *at, 90.0 if d else 30.0))
    found = {x["idx"]: x["dom"] for x in st.predicted_in_stages(spark.createDataFrame(rows, RES), min_ratio=1.0, max_rg=3.0).collect()}
    first, second = {found.get(k) for k in range(1, 46)}, {found.get(k) for k in range(61, 111)}
    assert not set(found) & {*range(46, 61), *range(111, 131)}
    assert first.isdisjoint(second - {None}) and len(found) >= 80


def test_extension_takes_confident_stretches(spark):
    """Against a direct reading of the rule: long enough confident free stretches go to the domain that pulls most, if near."""
    from foldloom.operators import structure as st

    r = random.Random(21)
    plddt = {k: 90.0 if r.random() < 0.8 or 20 <= k <= 45 else 40.0 for k in range(1, 91)}
    res = spark.createDataFrame([("p", k, 0.0, 0.0, 0.0, v) for k, v in plddt.items()], RES)
    edges = [("p", i, j, round(r.random(), 3)) for i in plddt for j in range(i + 1, 91) if r.random() < 0.15]
    start = {k: 1 for k in range(1, 15)} | {k: 2 for k in range(60, 71)}
    members, w = dict(start), {}
    for _, i, j, x in edges:
        w.setdefault(i, {})[j] = w.setdefault(j, {})[i] = x
    for _ in range(10):
        free = [k for k in sorted(plddt) if plddt[k] >= 70 and k not in members]
        runs, joins = [], {}
        for k in free:
            runs[-1].append(k) if runs and k - runs[-1][-1] == 1 else runs.append([k])
        for run in (x for x in runs if len(x) >= 4):
            pull, near = {}, set()
            for u in run:
                for v, x in w.get(u, {}).items():
                    if v in members:
                        pull[members[v]] = pull.get(members[v], 0) + x
                        near |= {members[v]} if run[0] - 12 <= v <= run[-1] + 12 else set()
            fits = [(-round(p, 9), d) for d, p in pull.items() if d in near]
            if fits:
                joins |= dict.fromkeys(run, min(fits)[1])
        if not joins:
            break
        members |= joins
    df = spark.createDataFrame([("p", k, d) for k, d in start.items()], "prot string, idx int, dom int")
    got = {x["idx"]: x["dom"] for x in st.extended(res, spark.createDataFrame(edges, EDGES), df, least=4, reach=12).collect()}
    assert got == members and len(got) > len(start)


@pytest.mark.parametrize("block", [2, 512])
def test_pairs_within_groups(spark, block):
    from foldloom.operators.networks import pairs_within

    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "a", "b", "c", None]), r.choice([*range(12), None])) for _ in range(120)]
    got = sorted((x["a"], x["b"]) for x in pairs_within(spark.createDataFrame(rows, "g string, f int"), "g", "f", block).collect())
    groups = {}
    for g, f in rows:
        if g and f is not None:
            groups.setdefault(g, set()).add(f)
    assert got == sorted({p for fs in groups.values() for p in combinations(sorted(fs), 2)})
    assert pairs_within(spark.createDataFrame([], "g string, f int"), "g", "f", block).count() == 0
