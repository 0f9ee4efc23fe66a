"""Texts into containers of a fixed number of tokens (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens
from foldloom.scratch import cut

CAPACITY, OPEN_BINS, TASKS_TOGETHER = 2048, 256, 64
PART_BITS = 36  # containers of one task are numbered below these bits
COLUMNS = "piece int, n_tokens bigint, container bigint, place bigint, token_offset bigint"


class Bins:
    """Best fit over a bounded number of open bins; a bit for each free size that some open bin has."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: dict[int, list[int]] = {}  # by free size: open bins
        self.bits = self.opened = self.n_open = 0
        self.held: dict[int, list[int]] = {}  # of each open bin: items, tokens

    def _take(self, free: int) -> int:
        bins = self.free[free]
        bin_ = bins.pop()
        if not bins:
            del self.free[free]
            self.bits &= ~(1 << free)
        return bin_

    def _give(self, bin_: int, free: int) -> None:
        self.free.setdefault(free, []).append(bin_)
        self.bits |= 1 << free

    def put(self, size: int) -> tuple[int, int, int]:
        """Bin, place from 1, and tokens before it; of the open bins the one that it fills most."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open == self.most:  # the fullest closes
                fullest = (self.bits & -self.bits).bit_length() - 1
                del self.held[self._take(fullest)]
                self.n_open -= 1
            bin_, free = self.opened, self.capacity
            self.opened, self.n_open = bin_ + 1, self.n_open + 1
            self.held[bin_] = [0, 0]
        state = self.held[bin_]
        before = state[1]
        state[0] += 1
        state[1] += size
        if free == size and size:
            del self.held[bin_]
            self.n_open -= 1
        else:
            self._give(bin_, free - size)
        return bin_, state[0], before


def pack_sizes(df: DataFrame, doc_id: str, n_tokens: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, n_tokens, container, place, token_offset: one row for each piece of each item.

    Each task packs its items as they come. A bin closes when full, or when a new one is needed while open_bins are
    open: then the fullest. Bins still open when a task ends are packed once more as if they were items, those of
    TASKS_TOGETHER tasks in one (at most TASKS_TOGETHER * open_bins of them).

    An item above capacity is cut into pieces that fill a container each and a rest; others are never cut. Items of
    size 0 take a place too; null sizes count as 0; an empty table gives no rows; other columns are ignored.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bins, base = Bins(capacity, open_bins), part << PART_BITS
        for batch in batches:
            row, out = [], []
            for k, size in enumerate(batch.column("n").to_pylist()):
                piece = 0
                while size > capacity:
                    row.append(k)
                    out.append((piece, capacity, base + bins.opened, 1, 0))
                    bins.opened += 1
                    size -= capacity
                    piece += 1
                bin_, place, before = bins.put(size)
                row.append(k)
                out.append((piece, size, base + bin_, place, before))
            yield _batch(batch.column("doc_id").take(pa.array(row, pa.int64())), out)
        left = [(-1, tokens, base + bin_, items, 0) for bin_, (items, tokens) in bins.held.items()]
        if left:
            yield _batch(pa.nulls(len(left), pa.string() if kind == "string" else pa.int64()), left)

    def _batch(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
        return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "piece", "n_tokens", "container", "place", "token_offset"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "container"], ascending=[False, True])
        bins, to, first, places = Bins(capacity, len(rows)), [], {}, {}
        for container, tokens, items in zip(rows.container, rows.n_tokens, rows.place, strict=True):
            bin_, _, before = bins.put(int(tokens))
            target = first.setdefault(bin_, container)
            to.append((container, target, places.get(bin_, 0), before))
            places[bin_] = places.get(bin_, 0) + items
        return pd.DataFrame(to, columns=["own", "target", "places", "tokens"])

    sizes = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("bigint").alias("n"))
    packed = cut(sizes.mapInArrow(run, f"doc_id {kind}, {COLUMNS}"), "packed")
    group = F.shiftright("container", PART_BITS + TASKS_TOGETHER.bit_length() - 1)
    moved = packed.where("piece < 0").withColumn("group", group).groupBy("group").applyInPandas(merge, "own bigint, target bigint, places bigint, tokens bigint")
    pieces = packed.where("piece >= 0").join(moved, F.col("container") == F.col("own"), "left")
    return pieces.select(
        "doc_id",
        "piece",
        "n_tokens",
        F.coalesce("target", "container").alias("container"),
        (F.col("place") + F.coalesce("places", F.lit(0))).alias("place"),
        (F.col("token_offset") + F.coalesce("tokens", F.lit(0))).alias("token_offset"),
    )


def pack_corpus(
    df: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """pack_sizes over the token counts of whole texts; null and empty texts have 0 tokens."""
    return pack_sizes(count_tokens(df, doc_id, text, folder, vocabulary), "doc_id", "n_tokens", capacity, open_bins)
