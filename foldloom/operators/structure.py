"""Residues, contacts and domains of protein structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.operators.greedy import greedy_picks
from foldloom.operators.intervals import overlap_join
from foldloom.scratch import cut


def contacts(residues: DataFrame, max_distance: float, min_separation: int = 1) -> DataFrame:
    """prot, i < j, d: residues at most max_distance apart and min_separation or more along the chain.

    Residues are met by cells of a grid as wide as the distance, each with its 26 neighbours, so far residues are
    never compared and a large protein spreads over tasks.
    """
    cell = lambda c: F.floor(F.col(c) / max_distance).cast("bigint")
    cells = residues.select("prot", "idx", "x", "y", "z", cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = cells.select(
        "prot",
        F.col("idx").alias("j"),
        F.col("x").alias("x2"),
        F.col("y").alias("y2"),
        F.col("z").alias("z2"),
        F.explode(F.flatten(F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.transform(steps, lambda c: F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy"), (F.col("cz") + c).alias("cz")))))))).alias("c"),
    ).select("prot", "j", "x2", "y2", "z2", "c.cx", "c.cy", "c.cz")
    met = cells.withColumnRenamed("idx", "i").join(near, ["prot", "cx", "cy", "cz"]).where(F.col("j") - F.col("i") >= min_separation)
    d = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) + (F.col("z") - F.col("z2")) * (F.col("z") - F.col("z2")))
    return met.select("prot", "i", "j", d.alias("d")).where(F.col("d") <= max_distance)


def weighted(edges: DataFrame, residues: DataFrame, sigma: float, pae_scale: float | None = None) -> DataFrame:
    """edges with w = confidence of both ends by 10,000, times exp(-d²/sigma²), times exp(-pae/scale) if given."""
    ends = residues.select("prot", "idx", "plddt")
    rows = edges.join(ends.withColumnsRenamed({"idx": "i", "plddt": "plddt_i"}), ["prot", "i"]).join(ends.withColumnsRenamed({"idx": "j", "plddt": "plddt_j"}), ["prot", "j"])
    w = F.col("plddt_i") * F.col("plddt_j") / 10000.0 * F.exp(-F.col("d") * F.col("d") / (sigma * sigma))
    if pae_scale:
        w = w * F.exp(-F.col("pae") / pae_scale)
    return rows.withColumn("w", w).drop("plddt_i", "plddt_j")


def with_bonds(edges: DataFrame, bonds: DataFrame, weight: float = 0.5) -> DataFrame:
    """edges (prot, i, j, w) with the weight of hydrogen bonds (prot, i, j, energy) added, or as new edges."""
    extra = bonds.groupBy("prot", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum(weight * F.least(F.lit(1.0), F.abs("energy") / 2)).alias("bond"))
    rows = edges.join(extra, ["prot", "i", "j"], "full")
    return rows.select("prot", "i", "j", (F.coalesce("w", F.lit(0.0)) + F.coalesce("bond", F.lit(0.0))).alias("w"), F.col("bond").isNotNull().alias("bonded"))


def _ends(edges: DataFrame, members: DataFrame) -> DataFrame:
    m = members.select("prot", "idx", "dom")
    return edges.join(m.withColumnsRenamed({"idx": "i", "dom": "dom_i"}), ["prot", "i"], "left").join(m.withColumnsRenamed({"idx": "j", "dom": "dom_j"}), ["prot", "j"], "left")


def contact_figures(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Of each domain its size, weighted contacts inside and to outside, their ratio (infinite without outside ones)
    and the share of possible contacts."""
    ends = _ends(edges, members)
    inside = ends.where("dom_i = dom_j").groupBy("prot", F.col("dom_i").alias("dom")).agg(F.sum("w").alias("internal"))
    crossing = ends.where("dom_i is distinct from dom_j").select("prot", F.explode(F.array("dom_i", "dom_j")).alias("dom"), "w")
    outside = crossing.where("dom is not null").groupBy("prot", "dom").agg(F.sum("w").alias("external"))
    rows = members.groupBy("prot", "dom").agg(F.count("*").alias("size")).join(inside, ["prot", "dom"], "left").join(outside, ["prot", "dom"], "left")
    a, b, n = F.coalesce("internal", F.lit(0.0)), F.coalesce("external", F.lit(0.0)), F.col("size")
    ratio = F.when(b == 0, F.when(a > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(a / F.when(b != 0, b))
    density = F.when(n < 2, F.lit(0.0)).otherwise(a / F.when(n >= 2, n * (n - 1) / 2))
    return rows.select("prot", "dom", "size", a.alias("internal"), b.alias("external"), ratio.alias("ratio"), density.alias("density"))


def compactness(residues: DataFrame, members: DataFrame) -> DataFrame:
    """Radius of gyration and confidence (mean, least, population deviation) of each domain."""
    rows = residues.join(members.select("prot", "idx", "dom"), ["prot", "idx"])
    return rows.groupBy("prot", "dom").agg(
        F.count("*").alias("size"),
        F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg"),
        F.avg("plddt").alias("mean_plddt"),
        F.min("plddt").alias("min_plddt"),
        F.stddev_pop("plddt").alias("sd_plddt"),
    )


def largest_dimension(residues: DataFrame, members: DataFrame) -> DataFrame:
    """prot, dom, max_dimension: the distance of the two residues of a domain that lie farthest apart.

    Two such residues lie together at least as far from the middle as the residue farthest from the middle lies from the
    one farthest from it; only residues that can be one of them are compared.
    """
    away = lambda a, b: F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0)))
    rows = residues.join(members.select("prot", "idx", "dom"), ["prot", "idx"]).select("prot", "dom", "idx", "x", "y", "z")
    middle = rows.groupBy("prot", "dom").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    rows = cut(rows.join(middle, ["prot", "dom"]).withColumn("r", away("", "m")).drop("mx", "my", "mz"), "residues")
    outer = rows.groupBy("prot", "dom").agg(F.max(F.struct("r", "x", "y", "z")).alias("o")).select("prot", "dom", F.col("o.r").alias("most"), *[F.col(f"o.{c}").alias(f"o{c}") for c in "xyz"])
    reach = rows.join(outer, ["prot", "dom"]).groupBy("prot", "dom").agg(F.max(away("", "o")).alias("known"), F.first("most").alias("most"))
    ends = rows.join(reach, ["prot", "dom"]).where("r + most >= known - 1e-9").select("prot", "dom", "idx", "x", "y", "z")
    other = ends.select("prot", "dom", F.col("idx").alias("jdx"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return ends.join(other, ["prot", "dom"]).where("idx <= jdx").groupBy("prot", "dom").agg(F.max(away("", "b")).alias("max_dimension"))


def isolated(residues: DataFrame, edges: DataFrame, window: int = 10, min_contacts: int = 3) -> DataFrame:
    """prot, idx of residues with fewer than min_contacts contacts at least `window` away along the chain."""
    far = edges.where(F.col("j") - F.col("i") >= window).select("prot", F.explode(F.array("i", "j")).alias("idx")).groupBy("prot", "idx").agg(F.count("*").alias("k"))
    return residues.select("prot", "idx").join(far.where(F.col("k") >= min_contacts), ["prot", "idx"], "left_anti")


def rescued(residues: DataFrame, edges: DataFrame, loose: DataFrame, clusters: DataFrame, min_size: int = 30, min_plddt: float = 50, max_gap: int = 20, min_ratio: float = 1.0, min_contacts: float = 3.0) -> DataFrame:
    """prot, dom, n: clusters (prot, idx, dom) whose disordered residues (loose: prot, idx) are a domain after all: enough of
    them, confident on average, without large gaps, and with as many contacts among each other as to others, or
    min_contacts for each residue."""
    rows = cut(clusters.select("prot", "idx", "dom").join(loose.select("prot", "idx"), ["prot", "idx"], "left_semi").join(residues.select("prot", "idx", "plddt"), ["prot", "idx"]), "loose")
    gap = F.col("idx") - F.lag("idx").over(Window.partitionBy("prot", "dom").orderBy("idx"))
    sums = rows.withColumn("gap", gap).groupBy("prot", "dom").agg(F.count("*").alias("n"), F.avg("plddt").alias("mean"), F.coalesce(F.max("gap"), F.lit(0)).alias("gap"))
    ends = _ends(edges, rows)
    inside = ends.where("dom_i = dom_j").groupBy("prot", F.col("dom_i").alias("dom")).agg(F.count("*").alias("inner"))
    outside = ends.where("dom_i is distinct from dom_j").select("prot", F.explode(F.array("dom_i", "dom_j")).alias("dom")).where("dom is not null").groupBy("prot", "dom").agg(F.count("*").alias("outer"))
    rows = sums.join(inside, ["prot", "dom"], "left").join(outside, ["prot", "dom"], "left").fillna(0, ["inner", "outer"])
    ratio = F.when(F.col("outer") > 0, F.col("inner") / F.when(F.col("outer") > 0, F.col("outer"))).otherwise(F.col("inner"))
    good = (F.col("n") >= min_size) & (F.col("mean") >= min_plddt) & (F.col("gap") <= max_gap)
    return rows.where(good & ((ratio >= min_ratio) | (2 * F.col("inner") / F.col("n") >= min_contacts))).select("prot", "dom", "n")


def triangles(edges: DataFrame) -> DataFrame:
    """prot, a, b, c and the weights w_ab, w_ac, w_bc of each triangle. Every edge leads from its end of fewer contacts to the
    other, so a hub begins few of the paths that may close."""
    degree = edges.select("prot", F.explode(F.array("i", "j")).alias("n")).groupBy("prot", "n").agg(F.count("*").alias("k"))
    rows = edges.select("prot", "i", "j", "w").join(degree.withColumnsRenamed({"n": "i", "k": "ki"}), ["prot", "i"]).join(degree.withColumnsRenamed({"n": "j", "k": "kj"}), ["prot", "j"])
    first = (F.col("ki") < F.col("kj")) | ((F.col("ki") == F.col("kj")) & (F.col("i") < F.col("j")))
    way = cut(rows.select("prot", F.when(first, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("b"), "w"), "ways")
    paths = way.withColumnRenamed("w", "w_ab").join(way.select("prot", "a", F.col("b").alias("c"), F.col("w").alias("w_ac")), ["prot", "a"]).where("b <> c")
    closing = way.select("prot", F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w_bc"))
    return paths.join(closing, ["prot", "b", "c"]).select("prot", "a", "b", "c", "w_ab", "w_ac", "w_bc")


def mean_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """prot, n_triangles, clustering: the weighted clustering coefficient, averaged over all nodes (prot, idx). A triangle
    counts with the cube root of the product of its weights, as shares of the protein's largest weight."""
    found = cut(triangles(edges), "triangles")
    top = edges.groupBy("prot").agg(F.max("w").alias("top"))
    share = F.cbrt(F.col("w_ab") * F.col("w_ac") * F.col("w_bc")) / F.col("top")
    own = found.join(top, "prot").select("prot", F.explode(F.array("a", "b", "c")).alias("n"), share.alias("share")).groupBy("prot", "n").agg(F.sum("share").alias("share"))
    degree = edges.select("prot", F.explode(F.array("i", "j")).alias("n")).groupBy("prot", "n").agg(F.count("*").alias("k"))
    sums = own.join(degree, ["prot", "n"]).groupBy("prot").agg(F.sum(2 * F.col("share") / (F.col("k") * (F.col("k") - 1))).alias("sum"))
    counts = found.groupBy("prot").agg(F.count("*").alias("n_triangles"))
    all_ = nodes.groupBy("prot").agg(F.count("*").alias("n_nodes"))
    rows = all_.join(sums, "prot", "left").join(counts, "prot", "left")
    return rows.select("prot", F.coalesce("n_triangles", F.lit(0)).alias("n_triangles"), (F.coalesce("sum", F.lit(0.0)) / F.col("n_nodes")).alias("clustering"))


def quality_score(plddt: Column, ratio: Column, rg: Column, size: Column, coverage: Column) -> Column:
    """0 to 100: confidence up to 50, contact ratio up to 25, compactness up to 15, coverage up to 10."""
    by_root = rg / F.sqrt(size)  # fixed values: the steps of compactness and the weights
    compact = F.when(by_root < 3, 15).when(by_root < 5, 10).when(by_root < 7, 5).otherwise(0)
    return F.least(F.lit(50.0), plddt / 2) + F.least(F.lit(25.0), ratio * 5) + compact + coverage * 10


def ratio_threshold(base: float, size: Column, plddt: Column) -> Column:
    """The contact ratio that a domain must reach: less for large and for confident ones."""
    # fixed values: the steps by size and confidence
    by_size = F.when(size <= 50, 1.0).when(size <= 100, 0.8).when(size <= 200, 0.7).otherwise(0.6)
    return base * by_size * F.when(plddt >= 90, 0.5).when(plddt >= 80, 0.7).otherwise(1.0)


def bridges(edges: DataFrame, width: int, min_separation: int, min_contacts: int, min_strength: float) -> DataFrame:
    """Pairs of distant stretches with enough contacts: prot, start, end, strength, n_contacts."""
    far = edges.where(F.col("j") - F.col("i") >= min_separation)
    block = lambda c: (F.floor(F.col(c) / width) * width).alias(f"block_{c}")
    rows = far.groupBy("prot", block("i"), block("j")).agg(F.min("i").alias("start"), F.max("j").alias("end"), F.sum("w").alias("strength"), F.count("*").alias("n_contacts"))
    return rows.where((F.col("n_contacts") >= min_contacts) & (F.col("strength") >= min_strength)).drop("block_i", "block_j")


def smallest_container(spans: DataFrame) -> DataFrame:
    """Of each span (prot, start, end) the smallest other span of the protein that contains it, if any."""
    outer = spans.select("prot", F.col("start").alias("o_start"), F.col("end").alias("o_end")).distinct()
    inner = spans.select("prot", "start", "end").distinct()
    starts = inner.withColumn("at", F.col("start"))  # a container holds the start, so it's enough to look there
    met = overlap_join(starts, outer, "prot", "start", "at", "o_start", "o_end").drop("at").where("end <= o_end and (o_start < start or end < o_end)")
    best = met.groupBy("prot", "start", "end").agg(F.min(F.struct((F.col("o_end") - F.col("o_start")).alias("span"), "o_start", "o_end")).alias("p"))
    return inner.join(best, ["prot", "start", "end"], "left").select("prot", "start", "end", F.col("p.o_start").alias("parent_start"), F.col("p.o_end").alias("parent_end"))


def disorder(residues: DataFrame, cutoff: float, window: int = 10, tail: int = 30) -> DataFrame:
    """Residues without order: in a window whose mean is under cutoff - 20, under 40 alone, or in an unbroken low tail."""
    along = Window.partitionBy("prot").orderBy("idx")
    low = cutoff - 20
    ahead = along.rowsBetween(0, window - 1)
    starts = (F.count("*").over(ahead) == window) & (F.avg("plddt").over(ahead) < low) & (F.min("plddt").over(ahead) < low)
    rows = residues.withColumn("_starts", starts.cast("int"))
    rows = rows.withColumn("_window", F.max("_starts").over(along.rowsBetween(-(window - 1), 0)))
    soft = (F.col("plddt") < cutoff - 10).cast("int")
    size = F.count("*").over(Window.partitionBy("prot"))
    from_start = (F.min(soft).over(along.rowsBetween(Window.unboundedPreceding, 0)) == 1) & (F.col("idx") <= tail)
    from_end = (F.min(soft).over(along.rowsBetween(0, Window.unboundedFollowing)) == 1) & (F.col("idx") > size - tail)
    rows = rows.withColumns({"low_window": F.col("_window") == 1, "very_low": F.col("plddt") < 40, "tail": from_start | from_end})
    return rows.drop("_starts", "_window")


def communities(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """prot, idx, dom: communities by weighted label propagation over all proteins at once.

    Every residue wants the label with the largest weight among its neighbours (ties: the smallest label). In each round
    about half of them, by a hash that differs from round to round, take it, so that neighbours don't swap labels for
    ever; it ends when nobody wants another, and raises if that takes more than `rounds`. Residues without contacts have no row.
    """
    both = cut(edges.select("prot", F.col("i").alias("u"), F.col("j").alias("v"), "w").unionAll(edges.select("prot", "j", "i", "w")), "edges")
    labels = both.select("prot", F.col("u").alias("v"), F.col("u").alias("dom")).distinct()
    for k in range(rounds):
        votes = both.join(labels, ["prot", "v"]).groupBy("prot", "u", "dom").agg(F.round(F.sum("w"), 9).alias("votes"))
        best = votes.groupBy("prot", "u").agg(F.max(F.struct("votes", (-F.col("dom")).alias("minus"))).alias("best"))
        wanted = best.select("prot", F.col("u").alias("v"), (-F.col("best.minus")).alias("want"))
        moves = F.shiftright(F.xxhash64("v"), k).bitwiseAND(F.lit(1).cast("bigint")) == 0
        new = cut(labels.join(wanted, ["prot", "v"]).select("prot", "v", F.when(moves, F.col("want")).otherwise(F.col("dom")).alias("new"), (F.col("want") != F.col("dom")).alias("wants")), "labels")
        labels = new.select("prot", "v", F.col("new").alias("dom"))
        if new.where("wants").isEmpty():
            return labels.select("prot", F.col("v").alias("idx"), "dom")
    raise RuntimeError(f"communities have not settled in {rounds} rounds")


def components(edges: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, node, first: each node of an edge with the smallest node of its connected component, in every group.

    Labels spread along edges and jump to the label of the label, so long chains take few rounds.
    """
    both = edges.select(group, F.col(a).alias("node"), F.col(b).alias("other")).unionAll(edges.select(group, F.col(b).alias("node"), F.col(a).alias("other")))
    both = cut(both.distinct(), "links")
    labels = both.groupBy(group, "node").agg(F.least(F.min("other"), F.first("node")).alias("first"))
    labels = cut(labels, "labels")
    while True:
        near = both.join(labels.select(group, F.col("node").alias("other"), "first"), [group, "other"]).groupBy(group, "node").agg(F.min("first").alias("near"))
        step = labels.join(near, [group, "node"]).select(group, "node", "first", F.least("first", "near").alias("new"))
        jump = labels.select(group, F.col("node").alias("new"), F.col("first").alias("far"))
        step = cut(step.join(jump, [group, "new"], "left").select(group, "node", "first", F.least("new", "far").alias("new")), "labels")
        labels = step.select(group, "node", F.col("new").alias("first"))
        if step.where("first <> new").isEmpty():
            return labels


def grown(edges: DataFrame, seeds: DataFrame, min_weight: float, min_size: int = 1) -> DataFrame:
    """prot, idx, dom: domains grown from seeds, all at the same time.

    In each round every free residue joins the domain to whose members its contacts weigh most, if at least
    min_weight (ties: the smallest domain); membership changes only after all have been weighed. Then domains of less
    than min_size residues dissolve and set theirs free. It ends when nothing changes: no domain comes back, so it does.
    """
    both = cut(edges.select("prot", F.col("i").alias("u"), F.col("j").alias("idx"), "w").unionAll(edges.select("prot", "j", "i", "w")), "edges")
    members = seeds.select("prot", "idx", "dom")
    while True:
        free = both.join(members.select("prot", F.col("idx").alias("u")), ["prot", "u"], "left_anti")
        pulls = free.join(members, ["prot", "idx"]).groupBy("prot", "u", "dom").agg(F.round(F.sum("w"), 9).alias("pull")).where(F.col("pull") >= min_weight)
        joins = pulls.groupBy("prot", "u").agg(F.max(F.struct("pull", (-F.col("dom")).alias("minus"))).alias("best"))
        joins = cut(joins.select("prot", F.col("u").alias("idx"), (-F.col("best.minus")).alias("dom")), "joins")
        members = cut(members.unionByName(joins), "members")
        dead = cut(members.groupBy("prot", "dom").agg(F.count("*").alias("n")).where(F.col("n") < min_size).select("prot", "dom"), "dead")
        if not dead.isEmpty():
            members = cut(members.join(dead, ["prot", "dom"], "left_anti").select("prot", "idx", "dom"), "members")
        elif joins.isEmpty():
            return members


def nearest_seed(residues: DataFrame, seeds: DataFrame) -> DataFrame:
    """prot, idx, dom: the nearest seed (prot, dom, sx, sy, sz) of each residue (ties: the smallest).

    The seeds of a protein come as one array to each of its residues, so no pair of residue and seed is shuffled.
    """
    listed = seeds.groupBy("prot").agg(F.collect_list(F.struct("dom", "sx", "sy", "sz")).alias("seeds"))
    d2 = lambda s: sum(((F.col(a) - s[f"s{a}"]) * (F.col(a) - s[f"s{a}"]) for a in "xyz"), F.lit(0.0))
    best = F.array_min(F.transform("seeds", lambda s: F.struct(d2(s).alias("d2"), s["dom"].alias("dom"))))
    return residues.join(listed, "prot").select("prot", "idx", best["dom"].alias("dom"))


def kmeans(residues: DataFrame, seeds: DataFrame, rounds: int = 100) -> DataFrame:
    """prot, idx, dom after moving each seed to the middle of its residues, for all proteins at once, until no residue changes
    its seed; raises if that takes more than `rounds`."""
    found = cut(nearest_seed(residues, seeds), "assigned")
    for _ in range(rounds):
        centres = residues.join(found, ["prot", "idx"]).groupBy("prot", "dom").agg(*[F.round(F.avg(a), 6).alias(f"s{a}") for a in "xyz"])
        before, found = found, cut(nearest_seed(residues, centres), "assigned")
        if found.join(before, ["prot", "idx", "dom"], "left_anti").isEmpty():
            return found
    raise RuntimeError(f"k-means has not settled in {rounds} rounds")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """prot, q: modularity of a partition over unweighted contacts."""
    total = edges.groupBy("prot").agg(F.count("*").alias("m"))
    degree = edges.select("prot", F.explode(F.array("i", "j")).alias("idx")).groupBy("prot", "idx").agg(F.count("*").alias("k"))
    by_dom = members.select("prot", "idx", "dom").join(degree, ["prot", "idx"]).groupBy("prot", "dom").agg(F.sum("k").alias("k"))
    inside = _ends(edges, members).where("dom_i = dom_j").groupBy("prot", F.col("dom_i").alias("dom")).agg(F.count("*").alias("a"))
    rows = by_dom.join(inside, ["prot", "dom"], "left").join(total, "prot")
    part = (F.coalesce("a", F.lit(0)) - F.col("k") * F.col("k") / (4.0 * F.col("m"))) / F.col("m")
    return rows.groupBy("prot").agg(F.sum(part).alias("q"))


def conductance(edges: DataFrame, members: DataFrame) -> DataFrame:
    """prot, dom, conductance: weight of the edges that leave a domain by the lesser volume of its two sides."""
    ends = _ends(edges, members)
    sides = ends.select("prot", F.explode(F.array(F.struct(F.col("dom_i").alias("dom"), F.col("dom_j").alias("other")), F.struct(F.col("dom_j").alias("dom"), F.col("dom_i").alias("other")))).alias("x"), "w")
    total = edges.groupBy("prot").agg((2 * F.sum("w")).alias("all"))
    leaves = F.when(~F.col("x.dom").eqNullSafe(F.col("x.other")), F.col("w")).otherwise(0.0)
    rows = sides.where("x.dom is not null").groupBy("prot", "x.dom").agg(F.sum("w").alias("vol"), F.sum(leaves).alias("cut")).join(total, "prot")
    least = F.least(F.col("vol"), F.col("all") - F.col("vol"))
    return rows.select("prot", "dom", F.when(least <= 1e-12, F.lit(1.0)).otherwise(F.col("cut") / F.when(least > 1e-12, least)).alias("conductance"))


def extended(residues: DataFrame, edges: DataFrame, members: DataFrame, cutoff: float = 70, least: int = 10, reach: int = 50, rounds: int = 10) -> DataFrame:
    """members (prot, idx, dom) with free stretches of at least `least` confident residues added to the domain to which
    their contacts weigh most (ties: the smallest), if it has a residue within `reach` of the stretch."""
    both = cut(edges.select("prot", F.col("i").alias("u"), F.col("j").alias("idx"), "w").unionAll(edges.select("prot", "j", "i", "w")), "edges")
    members = members.select("prot", "idx", "dom")
    confident = residues.where(F.col("plddt") >= cutoff).select("prot", "idx")
    by = Window.partitionBy("prot").orderBy("idx")
    for _ in range(rounds):
        free = confident.join(members, ["prot", "idx"], "left_anti")
        free = free.withColumn("_new", F.when(F.col("idx") - F.lag("idx").over(by) <= 1, 0).otherwise(1)).withColumn("run", F.sum("_new").over(by)).drop("_new")
        long = free.groupBy("prot", "run").agg(F.count("*").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b")).where(F.col("n") >= least)
        free = cut(free.join(long, ["prot", "run"]), "free")
        pulls = both.join(free.withColumnRenamed("idx", "u"), ["prot", "u"]).join(members, ["prot", "idx"])
        near = F.max(((F.col("idx") >= F.col("a") - reach) & (F.col("idx") <= F.col("b") + reach)).cast("int"))
        pulls = pulls.groupBy("prot", "run", "dom").agg(F.round(F.sum("w"), 9).alias("pull"), near.alias("near")).where("near = 1")
        best = pulls.groupBy("prot", "run").agg(F.max(F.struct("pull", (-F.col("dom")).alias("minus"))).alias("x"))
        joins = cut(free.join(best, ["prot", "run"]).select("prot", "idx", (-F.col("x.minus")).alias("dom")), "joins")
        if joins.isEmpty():
            break
        members = cut(members.unionByName(joins), "members")
    return members


def predicted_domains(residues: DataFrame, max_distance: float, sigma: float, cutoff: float = 70, min_size: int = 10, min_ratio: float = 0.2) -> DataFrame:
    """prot, idx, dom: communities of contacts without disordered residues, without those too small or too entangled."""
    edges = cut(weighted(contacts(residues, max_distance, 3), residues, sigma), "contacts")
    loose = disorder(residues, cutoff).where("low_window or very_low or tail").select("prot", "idx")
    members = cut(communities(edges).join(loose, ["prot", "idx"], "left_anti"), "members")
    good = contact_figures(edges, members).where((F.col("size") >= min_size) & (F.col("ratio") >= min_ratio)).select("prot", "dom")
    return members.join(good, ["prot", "dom"], "left_semi").select("prot", "idx", "dom")


def peak_seeds(residues: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """prot, idx: peaks of confidence within ten residues, the highest first, each at least ten residues from those before."""
    around = Window.partitionBy("prot").orderBy("idx").rowsBetween(-10, 10)
    peaks = residues.withColumn("top", F.max("plddt").over(around)).where("plddt >= top - 0.1").select("prot", "idx", (-F.round("plddt", 6)).alias("rank"))
    a = peaks.select("prot", F.col("idx").alias("a"), (F.col("idx") - 9).alias("lo"), (F.col("idx") + 9).alias("hi"))
    b = peaks.select("prot", F.col("idx").alias("b"), F.col("idx").alias("b_end"))
    near = overlap_join(a, b, "prot", "lo", "hi", "b", "b_end", 32).where("a < b").select("prot", "a", "b")
    return greedy_picks(peaks, near, "prot", "idx", "rank").where("idx = head").select("prot", "idx")


def grid_seeds(residues: DataFrame, spacing: float = 20.0, min_plddt: float = 70.0) -> DataFrame:
    """prot, idx: the confident residue nearest to each point of a grid around the protein (ties: the smallest). Every residue
    offers itself to the eight corners of its cell; corners of empty cells only have no seed of their own."""
    low = residues.groupBy("prot").agg(*[F.min(c).alias(f"l{c}") for c in "xyz"])
    rows = residues.where(F.col("plddt") >= min_plddt).join(low, "prot")
    corner = lambda c: F.floor((F.col(c) - F.col(f"l{c}")) / spacing).cast("bigint")
    steps = F.array(F.lit(0), F.lit(1))
    corners = F.flatten(F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.transform(steps, lambda c: F.struct((corner("x") + a).alias("gx"), (corner("y") + b).alias("gy"), (corner("z") + c).alias("gz")))))))
    rows = rows.select("*", F.explode(corners).alias("g"))
    d2 = sum(((F.col(c) - F.col(f"l{c}") - F.col(f"g.g{c}") * spacing) ** 2 for c in "xyz"), F.lit(0.0))
    best = rows.groupBy("prot", "g").agg(F.min(F.struct(F.round(d2, 6).alias("d2"), "idx")).alias("best"))
    return best.select("prot", "best.idx").distinct()


def random_seeds(residues: DataFrame, n: int = 5, min_plddt: float = 85.0, min_distance: float = 15.0, salt: str = "42") -> DataFrame:
    """prot, idx: up to n confident residues in a random order that repeats, each at least min_distance from those before."""
    rows = residues.where(F.col("plddt") >= min_plddt).withColumn("rank", F.md5(F.concat_ws("/", F.lit(salt), "prot", "idx")))
    near = contacts(rows, min_distance).where(F.col("d") < min_distance).select("prot", F.col("i").alias("a"), F.col("j").alias("b"))
    picks = greedy_picks(rows.select("prot", "idx", "rank"), near, "prot", "idx", "rank").where("idx = head").select("prot", "idx")
    first = Window.partitionBy("prot").orderBy("rank")
    ranked = picks.join(rows.select("prot", "idx", "rank"), ["prot", "idx"]).withColumn("k", F.row_number().over(first))
    return ranked.where(F.col("k") <= n).select("prot", "idx")


# strategies that choose seeds; further ones are added under their name
SEEDS = {"plddt_peaks": peak_seeds, "grid": grid_seeds, "random": random_seeds}


def seeds_by(residues: DataFrame, strategy: str, **parameters) -> DataFrame:
    """prot, idx of the seeds that a strategy chooses."""
    return SEEDS[strategy](residues, **parameters)


def trimmed_to_structured(residues: DataFrame, domains: DataFrame, cutoff: float = 70, min_size: int = 1) -> DataFrame:
    """domains (prot, dom, s, e) from their first to their last residue of at least the cutoff; those without one, or shorter
    than min_size then, leave."""
    good = residues.where(F.col("plddt") >= cutoff).select("prot", F.col("idx").alias("at"), F.col("idx").alias("at_end"))
    met = overlap_join(domains.select("prot", "dom", "s", "e"), good, "prot", "s", "e", "at", "at_end")
    rows = met.groupBy("prot", "dom").agg(F.min("at").alias("s"), F.max("at").alias("e"))
    return rows.where(F.col("e") - F.col("s") + 1 >= min_size)


def with_small_merged(edges: DataFrame, members: DataFrame, min_size: int) -> DataFrame:
    """members (prot, idx, dom) with each domain under min_size added to the one with most contacts to it (ties: the smallest),
    the smallest domain first (ties: the smallest number), until none is left that has contacts to another."""
    members = members.select("prot", "idx", "dom")
    while True:
        sizes = members.groupBy("prot", "dom").agg(F.count("*").alias("n"))
        ends = _ends(edges, members).where("dom_i <> dom_j")
        sides = F.explode(F.array(F.struct(F.col("dom_i").alias("dom"), F.col("dom_j").alias("other")), F.struct(F.col("dom_j").alias("dom"), F.col("dom_i").alias("other"))))
        links = ends.select("prot", sides.alias("x")).groupBy("prot", "x.dom", "x.other").agg(F.count("*").alias("k"))
        best = links.groupBy("prot", "dom").agg(F.max(F.struct("k", (-F.col("other")).alias("minus"))).alias("b"))
        small = best.join(sizes.where(F.col("n") < min_size), ["prot", "dom"])
        first = small.groupBy("prot").agg(F.min(F.struct("n", "dom", F.col("b.minus").alias("minus"))).alias("m"))
        moves = cut(first.select("prot", "m.dom", (-F.col("m.minus")).alias("into")), "moves")
        if moves.isEmpty():
            return members
        members = cut(members.join(moves, ["prot", "dom"], "left").select("prot", "idx", F.coalesce("into", "dom").alias("dom")), "members")


def predicted_in_stages(
    residues: DataFrame, max_distance: float = 10.0, sigma: float = 10.0, cutoff: float = 70, min_size: int = 30, min_ratio: float = 0.5, max_rg: float = 2.0
) -> DataFrame:
    """prot, idx, dom: contacts, communities of them, disordered and isolated residues taken out, structured clusters among these
    rescued, small domains merged into neighbours, entangled and loose ones filtered, and the rest grown into the confident
    stretches next to them."""
    edges = cut(weighted(contacts(residues, max_distance, 3), residues, sigma), "contacts")
    clusters = cut(communities(edges), "clusters")
    loose = disorder(residues, cutoff).where("low_window or very_low or tail").select("prot", "idx").union(isolated(residues, edges)).distinct()
    loose = cut(loose, "loose")
    back = rescued(residues, edges, loose, clusters, min_size).select("prot", "dom", F.lit(True).alias("back"))
    marked = clusters.join(loose.withColumn("loose", F.lit(True)), ["prot", "idx"], "left").join(back, ["prot", "dom"], "left")
    members = cut(marked.where("loose is null or back").select("prot", "idx", "dom"), "members")
    members = with_small_merged(edges, members, min_size)
    figures = contact_figures(edges, members).join(compactness(residues, members).drop("size"), ["prot", "dom"])
    compact = F.col("rg") <= max_rg * 2.5 * F.pow("size", F.lit(1.0 / 3))
    good = figures.where((F.col("size") >= min_size) & (F.col("ratio") >= min_ratio) & compact).select("prot", "dom")
    kept = cut(members.join(good, ["prot", "dom"], "left_semi").select("prot", "idx", "dom"), "members")
    return extended(residues, edges, kept, cutoff)
