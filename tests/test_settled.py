from foldloom.operators import structure as st

RES = "prot string, idx int, x double, y double, z double, plddt double"


def test_growth_and_means_settle(spark):
    near = [("p", i, j, 1.0) for i in range(1, 61) for j in range(i + 1, min(i + 3, 61))]  # a strip: two residues a round
    block = [("p", i, j, 1.0) for i in range(1, 19) for j in range(i + 3, 19)]  # 18 residues at its start, grown at once
    pair = [("q", 1, 2, 1.0)]
    edges = spark.createDataFrame(near + block + pair, "prot string, i int, j int, w double")
    seeds = spark.createDataFrame([("p", 1, 1), ("p", 60, 60), ("q", 1, 1)], "prot string, idx int, dom int")
    got = {(x["prot"], x["idx"]): x["dom"] for x in st.grown(edges, seeds, 0.05, min_size=15).collect()}
    assert got == {("p", k): 1 for k in range(1, 61)}  # over ten rounds; domains of two residues and one dissolve

    points = [("p", k, 1.1**k, 0.0, 0.0, 90.0) for k in range(1, 61)]
    res = spark.createDataFrame(points, RES)
    start = spark.createDataFrame([("p", k, points[k][2], 0.0, 0.0) for k in range(3)], "prot string, dom int, sx double, sy double, sz double")
    dom = {x["idx"]: x["dom"] for x in st.kmeans(res, start).collect()}
    mean = {d: sum(p[2] for p in points if dom[p[1]] == d) / sum(v == d for v in dom.values()) for d in set(dom.values())}
    assert all(abs(p[2] - mean[dom[p[1]]]) <= min(abs(p[2] - m) for m in mean.values()) + 1e-5 for p in points)
