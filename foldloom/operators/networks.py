"""Networks of families and proteins: best edges, methods side by side, neighbourhoods, domain frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions.scores import wilson_lower_bound
from foldloom.scratch import cut


def best_edges(hits: DataFrame, a: str, b: str, value: str, lowest: bool = True) -> DataFrame:
    """The best value of each unordered pair of different ends: fam_1 < fam_2, value, n_rows."""
    rows = hits.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("fam_1"), F.greatest(a, b).alias("fam_2"))
    return rows.agg((F.min if lowest else F.max)(value).alias(value), F.count("*").alias("n_rows"))


def methods_side_by_side(edges: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """One row for each pair found by any method, a column for each method, and how many methods found it."""
    rows = None
    for name, df in edges.items():
        part = df.select(*keys, F.lit(name).alias("method"), F.col(value).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    wide = rows.groupBy(*keys).pivot("method", list(edges)).agg(F.min("value"))
    found: Column = sum((F.col(m).isNotNull().cast("int") for m in edges), F.lit(0))
    return wide.withColumn("n_methods", found)


def neighbourhood(edges: DataFrame, a: str, b: str, start: DataFrame, node: str, hops: int) -> DataFrame:
    """node and hop for each node within `hops` steps of start, over edges in both directions; the start has hop 0."""
    both = edges.select(F.col(a).alias("from"), F.col(b).alias("to")).unionAll(edges.select(F.col(b).alias("from"), F.col(a).alias("to"))).distinct()
    seen = start.select(F.col(node).alias("node")).distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        reached = seen.where(F.col("hop") == hop - 1).join(both, F.col("node") == F.col("from")).select(F.col("to").alias("node")).distinct()
        fresh = reached.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = cut(seen.unionByName(fresh), "hops")
    return seen


BLOCK_LINKS = 1 << 20  # links of a block of nodes, the most that two of are in a task at once
CHUNK_PATHS = 1 << 21  # paths of two links that are sorted at once


def neighbourhoods(edges: DataFrame, a: str, b: str, starts: DataFrame, node: str, hops: int) -> DataFrame:
    """start, node and hop for each node within `hops` steps of each of starts, as neighbourhood gives them for one set.

    Links are shuffled once, to a list of neighbours for each node. From the second hop on, nodes are cut in blocks of about
    BLOCK_LINKS links; each block of starts is met with each block of nodes, and what the one reaches of the other is made in
    one task. So the pairs of start and node, many more than the links, are neither shuffled nor written before the result
    is; only from the third hop on they are. A node with many links lies in one block.
    """
    x, y = F.col(a), F.col(b)
    chosen = starts.select(F.col(node).alias("x")).where("x is not null").distinct()
    both = edges.select(x.alias("x"), y.alias("y"), F.lit(False).alias("own")).unionAll(edges.select(y.alias("x"), x.alias("y"), F.lit(False).alias("own")))
    rows = both.unionAll(chosen.select("x", F.lit(None).cast(both.schema["y"].dataType).alias("y"), F.lit(True).alias("own"))).repartition("x")
    met = F.expr("collect_set(y) filter (where not own)")
    near = F.when(F.expr("bool_or(y is null and not own)"), F.array_append(met, F.lit(None))).otherwise(met)  # a set leaves out nulls
    lists = cut(rows.groupBy("x").agg(near.alias("near"), F.bool_or("own").alias("chosen")), "links")
    seen = lists.where("chosen").select(F.col("x").alias("start"), F.col("x").alias("node"), F.lit(0).alias("hop"))
    if hops < 1:
        return seen
    first = lists.where("chosen").select(F.col("x").alias("start"), F.explode("near").alias("node"), F.lit(1).alias("hop"))
    seen = seen.unionAll(first.where(~F.col("node").eqNullSafe(F.col("start"))))
    if hops < 2:
        return seen
    blocks = _blocks(lists)
    frontier = blocks
    for hop in range(2, hops + 1):
        fresh = _reached(frontier, blocks).select("start", F.explode("nodes").alias("node"), F.lit(hop).alias("hop"))
        if hop > 2:  # one hop back and the start were left out already
            known = seen.select(F.col("start").alias("_start"), F.col("node").alias("_node"))
            fresh = fresh.join(known, (F.col("start") == F.col("_start")) & F.col("node").eqNullSafe(F.col("_node")), "left_anti")
        if hop < hops:
            fresh = cut(fresh, "hops")
            frontier = _blocks(fresh.groupBy(F.col("start").alias("x")).agg(F.collect_list("node").alias("near"), F.lit(True).alias("chosen")))
        seen = seen.unionAll(fresh)
    return seen


def _blocks(lists: DataFrame) -> DataFrame:
    """A row for each block of the nodes x: its nodes, all their neighbours (far) once, and places in far and in nodes:
    that of each node's neighbours, from its offset (out_at), and of each neighbour's nodes (in_at)."""
    links = lists.agg(F.sum(F.size("near"))).first()[0] or 0
    n = int(max(-(-links // BLOCK_LINKS), min(8, -(-links // 4096)), 1))
    kind = lists.schema["x"].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        near = pa.concat_arrays(t["near"].chunks)
        coded = near.flatten().dictionary_encode(null_encoding="encode")
        out, counts = coded.indices.to_numpy(), near.value_lengths().to_numpy()
        whole = lambda v: pa.array(v, pa.int32())
        columns = {
            "nodes": pa.concat_arrays(t["x"].chunks), "chosen": pa.concat_arrays(t["chosen"].chunks), "far": coded.dictionary,
            "out_at": whole(np.append(0, np.cumsum(counts))), "out": whole(out),
            "in_at": whole(np.append(0, np.cumsum(np.bincount(out, minlength=len(coded.dictionary))))), "in": whole(np.repeat(np.arange(len(counts)), counts)[np.argsort(out, kind="stable")]),
        }
        return pa.table({k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in columns.items()})

    rows = lists.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(n)).cast("int")).repartitionById(n, "block")
    schema = f"nodes array<{kind}>, chosen array<boolean>, far array<{kind}>, out_at array<int>, out array<int>, in_at array<int>, in array<int>"
    return cut(rows.groupBy("block").applyInArrow(pack, schema), "blocks")


def _reached(frontier: DataFrame, blocks: DataFrame) -> DataFrame:
    """start and nodes: what the links of blocks reach of one block from the neighbours of a chosen node of frontier, without
    the node and these neighbours. Links go both ways, so the neighbours of a node are those it is reached from."""
    kind = blocks.schema["nodes"].dataType.elementType.simpleString()
    left = frontier.select(F.col("nodes").alias("starts"), "chosen", F.col("far").alias("mids"), "out_at", "out")
    right = blocks.select("nodes", "far", "in_at", "in")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for starts, at, nodes in _two_links(*(batch.column(c)[k].values for c in batch.schema.names)):
                    yield pa.RecordBatch.from_arrays([starts, pa.ListArray.from_arrays(at, nodes)], names=["start", "nodes"])

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, f"start {kind}, nodes array<{kind}>")


def _two_links(starts, chosen, mids, out_at, out, nodes, far, in_at, in_) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Starts, offsets and nodes for the paths start - mid - node, by chunks of starts."""
    place = lambda x, among: pc.fill_null(pc.index_in(x, value_set=among), -1).to_numpy()
    out_at, out, in_at, in_ = (v.to_numpy() for v in (out_at, out, in_at, in_))
    via = np.where(pc.is_null(mids).to_numpy(zero_copy_only=False), -1, place(mids, far))  # a null leads nowhere
    steps = np.where(via < 0, 0, in_at[via + 1] - in_at[via]) if len(far) else np.zeros(len(via), np.int64)
    known, own = place(mids, nodes), place(starts, nodes)
    paths = np.append(0, np.cumsum(steps[out]))[out_at]  # in front of each start
    wanted = chosen.to_numpy(zero_copy_only=False)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(paths, paths[low] + CHUNK_PATHS, "right")) - 1)
        picked = np.flatnonzero(wanted[low:high]) + low
        counts = out_at[picked + 1] - out_at[picked]
        edges = np.repeat(out_at[picked] - np.append(0, np.cumsum(counts))[:-1], counts) + np.arange(counts.sum())
        row, mid = np.repeat(picked, counts).astype(np.int64) << 32, out[edges]
        n = steps[mid]
        ends = np.repeat(in_at[via[mid]] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        pairs = np.repeat(row, n) | in_[ends]
        pairs.sort()
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = pairs[1:] != pairs[:-1]
        pairs = pairs[fresh]
        before = np.concatenate([(row | known[mid])[known[mid] >= 0], (picked.astype(np.int64) << 32 | own[picked])[own[picked] >= 0]])
        at = np.searchsorted(pairs, before)
        at = at[at < len(pairs)] if not len(pairs) else at[pairs[np.minimum(at, len(pairs) - 1)] == before]
        pairs = np.delete(pairs, at)
        if len(pairs):
            row = (pairs >> 32).astype(np.int32)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            yield starts.take(pa.array(row[first])), pa.array(np.append(first, len(row)), pa.int32()), nodes.take(pa.array(pairs.astype(np.int32)))
        low = high


def pairs_within(df: DataFrame, group: str, item: str, block: int = 512) -> DataFrame:
    """a < b: each pair of different items that some group holds together, once.

    Groups with the same items are paired once. A group of more than `block` items is cut in blocks of about so many, and each
    two blocks are paired under a key of their own, so no task holds the pairs of a large group.
    """
    rows = df.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    placed = rows.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(item), F.col("_blocks")))
    parts = cut(placed.groupBy(group, "_blocks", "_block").agg(F.sort_array(F.collect_list(item)).alias("_own")), "blocks")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    own = parts.select("_own").distinct()
    within = F.flatten(F.transform("_own", lambda x, i: F.transform(F.slice("_own", i + 2, F.size("_own")), lambda y: pair(x, y))))
    left = parts.where("_block < _blocks - 1").select(group, F.col("_block").alias("_i"), F.explode(F.expr("sequence(_block + 1, _blocks - 1)")).alias("_j"), "_own")
    right = parts.where("_block > 0").select(group, F.explode(F.expr("sequence(0, _block - 1)")).alias("_i"), F.col("_block").alias("_j"), F.col("_own").alias("_other"))
    between = left.join(right, [group, "_i", "_j"]).select("_own", "_other").distinct()
    across = F.flatten(F.transform("_own", lambda x: F.transform("_other", lambda y: pair(x, y))))
    return own.select(F.inline(within)).unionAll(between.select(F.inline(across))).distinct()


def domain_frequencies(memberships: DataFrame, network: str, domain: str, min_frequency: float = 0.3, min_networks: int = 5, min_bound: float = 0.0) -> DataFrame:
    """Of each domain in how many networks it occurs, the share of all networks, and its Wilson lower bound."""
    total = memberships.agg(F.countDistinct(network).alias("n_all"))
    counts = memberships.groupBy(domain).agg(F.countDistinct(network).alias("n_networks")).crossJoin(F.broadcast(total))  # one row
    share = F.col("n_networks") / F.col("n_all")
    rows = counts.select(domain, "n_networks", F.round(share, 6).alias("frequency"), F.round(wilson_lower_bound(F.col("n_networks"), F.col("n_all")), 6).alias("bound"))
    return rows.where((F.col("frequency") >= min_frequency) & (F.col("n_networks") >= min_networks) & (F.col("bound") >= min_bound))


def family_statistics(hits: DataFrame, family: str, target: str, evalue: str, score: str, order: str) -> DataFrame:
    """Number of hits, best hit (lowest E-value; ties: lowest order) and hits under 1e-10 of each family."""
    best = F.min(F.struct(F.col(evalue).alias("evalue"), F.col(order).alias("ord"), F.col(target).alias("target"), F.col(score).alias("score")))
    rows = hits.where(F.col(evalue).isNotNull()).groupBy(family).agg(F.count("*").alias("n_hits"), best.alias("best"), F.count_if(F.col(evalue) < 1e-10).alias("n_strong"))
    return rows.select(family, "n_hits", F.col("best.evalue").alias("best_evalue"), F.col("best.target").alias("best_target"), F.col("best.score").alias("best_score"), "n_strong")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that must have no ties."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
