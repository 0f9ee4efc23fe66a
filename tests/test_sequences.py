import math
import random

from foldloom.operators.islands import core_segments, without_intrusions
from foldloom.operators.sequences import non_redundant, sequence_clusters, superposed
from foldloom.operators.structure import extended, predicted_domains


def test_sequence_clusters(spark):
    r = random.Random(1)
    base = ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(80)) for _ in range(4)]
    rows = [(10 * k + n, s[n : 80 - n]) for k, s in enumerate(base) for n in range(4)] + [(100, "ACD"), (101, None)]
    got = {x["k"]: x["representative"] for x in sequence_clusters(spark.createDataFrame(rows, "k bigint, s string"), "k", "s").collect()}
    assert got == {10 * k + n: 10 * k for k in range(4) for n in range(4)}


def test_superposed(spark):
    r = random.Random(2)
    turn, rows = 0.7, []
    for key, mirror in (("turned", 1), ("mirrored", -1)):
        for _ in range(30):
            x, y, z = (r.uniform(-9, 9) for _ in range(3))
            rows.append((key, x, y, z, x * math.cos(turn) - y * math.sin(turn) + 5, x * math.sin(turn) + y * math.cos(turn), mirror * z - 2))
    got = {x["k"]: x for x in superposed(spark.createDataFrame(rows, "k string, x double, y double, z double, x2 double, y2 double, z2 double"), ["k"]).collect()}
    assert got["turned"]["rmsd"] < 1e-5 and got["mirrored"]["rmsd"] > 1
    assert [round(v, 6) for v in got["turned"]["rotation"]] == [round(v, 6) for v in (math.cos(turn), math.sin(turn), 0, -math.sin(turn), math.cos(turn), 0, 0, 0, 1)]


def test_core_segments(spark):
    segs = [("p", 1, 40), ("p", 60, 75), ("p", 100, 120), ("p", 125, 127), ("p", 190, 192), ("p", 160, 175), ("q", 5, 6)]
    got = sorted(tuple(x) for x in core_segments(spark.createDataFrame(segs, "k string, seg_s int, seg_e int"), ["k"], 30).collect())
    assert got == sorted([("p", 1, 40), ("p", 60, 75), ("p", 100, 120), ("p", 125, 127), ("p", 160, 175), ("q", 5, 6)])


def test_without_intrusions(spark):
    df = spark.createDataFrame([("p", k, d) for k, d in enumerate([1, 1, 1, 2, 1, 1, 3, 3, 3, 2])], "k string, i int, dom int")
    assert [x["dom"] for x in without_intrusions(df, ["k"], "i", "dom", 2).orderBy("i").collect()] == [1, 1, 1, 1, 1, 1, 3, 3, 3, 2]


def test_extension_and_prediction(spark):
    rows = [("p", k, float(k % 20) * 2, 100.0 * (k > 20), 0.0, 90.0) for k in range(1, 41)]
    res = spark.createDataFrame(rows, "prot string, idx int, x double, y double, z double, plddt double")
    found = predicted_domains(res, 12.0, 10.0, min_size=3, min_ratio=0.01).collect()
    assert found and all((x["idx"] > 20) == (x["dom"] > 20) for x in found)
    edges = spark.createDataFrame([("p", k, k + 1, 1.0) for k in range(1, 40)], "prot string, i int, j int, w double")
    core = spark.createDataFrame([("p", k, 1) for k in range(1, 6)], "prot string, idx int, dom int")
    assert extended(res, edges, core, least=10).count() == 40


def test_non_redundant(spark):
    r = random.Random(4)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    first, second = ("".join(r.choice(letters) for _ in range(60)) for _ in range(2))
    near = "".join("-" if k % 17 == 5 else "W" if k % 11 == 3 else c for k, c in enumerate(first))  # over four fifths equal
    far = "".join(c if k % 2 else r.choice(letters) for k, c in enumerate(first))
    rows = [("f", 1, first), ("f", 2, near), ("f", 3, second), ("f", 4, first), ("g", 5, near), ("f", 6, far), (None, 7, first), ("f", 8, "--")]
    got = {x["id"]: x["representative"] for x in non_redundant(spark.createDataFrame(rows, "fam string, id bigint, aln string"), "fam", "id", "aln").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


def _greedy(rows, alike):
    """rows of (key, text), longest first: what one pass decides."""
    heads, picked = {}, []
    for key, text in sorted(rows, key=lambda x: (-len(x[1].replace("-", "")), x[0])):
        heads[key] = next((p for p, other in picked if alike(text, other)), key)
        if heads[key] == key:
            picked.append((key, text))
    return heads


def test_clusters_with_common_words_in_longer_rows(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    core = text(40)
    rows = [(1, core + text(20)), (2, core + text(20)), (3, core[:22] + text(120)), (4, core[18:] + text(120)), (5, text(60) + core[10:32] + text(60)), (6, core + text(20))]
    pool = [text(15) for _ in range(12)]
    rows += [(100 + k, "".join(r.choice(pool) for _ in range(r.randint(1, 8)))) for k in range(80)]
    words = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    want = _greedy(rows, lambda a, b: len(words(a) & words(b)) >= 0.5 * min(len(words(a)), len(words(b))))
    got = sequence_clusters(spark.createDataFrame(rows, "k bigint, s string"), "k", "s").collect()
    assert want[2] == want[6] == 1 and {x["k"]: x["representative"] for x in got} == want


def test_non_redundant_compares_all_rows(spark, monkeypatch):
    monkeypatch.setattr("foldloom.operators.sequences.BLOCK", 16)  # several blocks of a family
    r = random.Random(9)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    base = text(50)
    rows = [(1, base + "-"), (2, base[:-1] + "--"), (3, "W" + base), (4, "AC" + "-" * 49)]
    seeds = [text(50) for _ in range(6)]
    rows += [(10 + k, "".join("-" if r.random() < 0.1 else r.choice(letters) if r.random() < 0.12 else c for c in seeds[k % 6])) for k in range(60)]

    def alike(a, b):
        both = [x == y for x, y in zip(a, b) if x != "-" and y != "-"]
        return bool(both) and sum(both) >= 0.8 * len(both)

    got = non_redundant(spark.createDataFrame([("f", *x) for x in rows], "fam string, id bigint, aln string"), "fam", "id", "aln").collect()
    want = _greedy(rows, alike)
    assert want[2] == 1 and {x["id"]: x["representative"] for x in got} == want
