"""Figures for each key where a few keys hold most rows (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "part bigint, place bigint, key string, n bigint, n_items bigint, first_item string, last_item string, best_score double, best_row bigint"


def _states_of(batch: pa.RecordBatch) -> list[dict]:
    """One partial state for each key of a batch that is sorted by key, item (nulls first)."""
    n = batch.num_rows
    key, item, score, row = (batch.column(c) for c in ("key", "item", "score", "row_id"))
    new_key = np.ones(n, bool)
    new_key[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    has_item = item.is_valid().to_numpy(zero_copy_only=False)
    new_item = new_key.copy()
    new_item[1:] |= pc.fill_null(pc.not_equal(item[1:], item[:-1]), True).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new_key)
    ends = np.append(at[1:], n)
    s = score.to_numpy(zero_copy_only=False)
    ids = row.to_numpy()
    best = np.lexsort((ids, np.where(np.isnan(s), np.inf, s), np.isnan(s), np.cumsum(new_key)))[at]
    none = np.isnan(s[best])
    first = at + np.add.reduceat(~has_item, at)
    empty = first >= ends
    return pa.table(
        {
            "key": key.take(pa.array(at)),
            "n": ends - at,
            "n_items": np.add.reduceat((new_item & has_item).astype(np.int64), at),
            "first_item": item.take(pa.array(np.where(empty, 0, first), mask=empty)),
            "last_item": item.take(pa.array(ends - 1, mask=empty)),
            "best_score": pa.array(s[best], mask=none),
            "best_row": pa.array(ids[best], mask=none),
        }
    ).to_pylist()


def _joined(a: dict, b: dict) -> dict:
    """The state of two neighbouring runs of one key, a before b."""
    best = min((x for x in (a, b) if x["best_row"] is not None), key=lambda x: (x["best_score"], x["best_row"]), default=a)
    return {
        "key": a["key"],
        "n": a["n"] + b["n"],
        "n_items": a["n_items"] + b["n_items"] - (a["last_item"] is not None and a["last_item"] == b["first_item"]),
        "first_item": b["first_item"] if a["first_item"] is None else a["first_item"],
        "last_item": a["last_item"] if b["last_item"] is None else b["last_item"],
        "best_score": best["best_score"],
        "best_row": best["best_row"],
    }


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of a sorted partition, one for each key, in order."""
    part, place, held = TaskContext.get().partitionId(), 0, None
    schema = pa.schema([(c, pa.string() if "item" in c and c != "n_items" or c == "key" else pa.float64() if c == "best_score" else pa.int64()) for c in (x.split()[0] for x in STATE.split(", "))])
    for batch in batches:
        if not batch.num_rows:
            continue
        states = _states_of(batch)
        if held and held["key"] == states[0]["key"]:
            states[0] = _joined(held, states[0])
        elif held:
            states.insert(0, held)
        held = states.pop()
        for x in states:
            x["part"], x["place"], place = part, place, place + 1
        yield pa.RecordBatch.from_pylist(states, schema)
    if held:
        yield pa.RecordBatch.from_pylist([held | {"part": part, "place": place}], schema)


def figures_by_key(df: DataFrame, key: str, item: str, score: str, row_id: str) -> DataFrame:
    """Of each key: n_rows, n_items (distinct items), best_row_id (lowest score; ties: lowest row_id; 0 without scores).

    Rows are range-partitioned by (key, item, row_id) with sampled quantiles, so a key that holds most rows is spread
    over many tasks. Each task gives one partial state for each key it meets; the states of a key are then stitched in
    order: an item that ends one state and begins the next counts once. There are at most as many states as keys and
    tasks together.

    Rows with null key don't count; null items and null or NaN scores count as rows only; repeated rows count as
    rows; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(
        F.col(key).cast("string").alias("key"),
        F.col(item).cast("string").alias("item"),
        F.col(score).cast("double").alias("score"),
        F.col(row_id).cast("bigint").alias("row_id"),
    ).where("key is not null")
    order = ["key", "item", "row_id"]
    states = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_partials, STATE)
    by = Window.partitionBy("key").orderBy("part", "place")
    before = F.last("last_item", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    states = states.withColumn("again", F.when(F.col("first_item") == before, 1).otherwise(0))
    return states.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n_items") - F.col("again")).alias("n_items"),
        F.coalesce(F.min(F.when(F.col("best_row").isNotNull(), F.struct("best_score", "best_row")))["best_row"], F.lit(0).cast("bigint")).alias("best_row_id"),
    )
