"""Filling containers of fixed capacity: minimum bin slack by bitset subset sums.

Documents are spread over windows of ``window`` items. Within a window the
largest remaining item opens a container; a subset-sum program over the
multiset of remaining lengths, held as one big integer whose bit s says that
sum s is reachable, finds the subset that fills the rest closest to capacity,
and the counts of each length are traced back. Containers of a window that
stay under ``keep_fill`` are dissolved and packed again together with those of
the other windows of a group of ``merge`` windows, so poor containers are few
however many windows there are. Windows are numbered over all tasks, and both
passes have tasks in proportion to the items, whatever the shuffle setting.
The first pass is written once; only rows of dissolved containers move again.

An item is split only if it exceeds the capacity: full containers of its own,
and the remainder is packed as an item.

Cases: items of size 0 (null or empty text) take no room and have a null
container; equal sizes are taken in the order of their ids; rows repeated with
the same id are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.session import materialise

CAPACITY = 4096
WINDOW = 4096
SCHEMA = "id long, n_tokens long, piece_no int, size long, container long, part int, win int"
_ARROW = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("piece_no", pa.int32()), ("size", pa.int64()), ("container", pa.int64()), ("part", pa.int32()), ("win", pa.int32())])
#: windows that one task packs
TASK_WINDOWS = 8


def fill_one(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts by length of the sub-multiset whose sum is closest to ``room`` from below. ``lengths`` are in descending order."""
    reach, mask = 1, (1 << (room + 1)) - 1
    stages: list[tuple[int, int, int]] = []
    for n in lengths:
        if n > room:
            continue
        left, step = min(counts[n], room // n), 1
        while left > 0:  # copies in powers of two
            step = min(step, left)
            grown = (reach | (reach << (n * step))) & mask
            if grown != reach:
                stages.append((n, step, reach))
                reach = grown
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for n, step, before in reversed(stages):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + step
            at -= n * step
    return used


def pack_window(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item of a window, each size within 1..capacity."""
    out = np.full(len(sizes), -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    items: dict[int, list[int]] = {}
    for i in order:
        items.setdefault(int(sizes[i]), []).append(int(i))
    for v in items.values():
        v.reverse()  # pop() gives the first
    counts = {n: len(v) for n, v in items.items()}
    lengths = list(items)
    box = 0
    while lengths:
        n = lengths[0]
        take = {n: 1}
        counts[n] -= 1
        room = capacity - n
        if room:
            for m, c in fill_one(lengths, counts, room).items():
                take[m] = take.get(m, 0) + c
                counts[m] -= c
        for m, c in take.items():
            for _ in range(c):
                out[items[m].pop()] = box
        lengths = [m for m in lengths if counts[m]]
        box += 1
    return out


def _explode(capacity: int, ids: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Items of the documents: whole ones, and the pieces of those too large."""
    n = np.maximum(1, -(-tokens // capacity))
    at = np.repeat(np.arange(len(ids)), n)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(capacity, tokens[at] - piece * capacity)
    return ids[at], tokens[at], piece.astype(np.int32), size


def _pack(capacity: int, window: int, keep_fill: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0

        def flush(cols: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            nonlocal no
            ids, tokens = (np.concatenate(x) for x in zip(*cols))
            ids, tokens, piece, size = _explode(capacity, ids, tokens)
            box = np.full(len(ids), -1, np.int64)
            real = np.flatnonzero(size > 0)
            if len(real):
                box[real] = pack_window(size[real], capacity)
                fill = np.bincount(box[real], weights=size[real])
                poor = fill < keep_fill * capacity
                box[real] = np.where(poor[box[real]], -2, box[real] + (part << 44) + (no << 24))
            own = [pa.array(np.full(len(ids), v, np.int32)) for v in (part, no)]
            no += 1
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tokens), pa.array(piece), pa.array(size), pa.array(box), *own], schema=_ARROW)

        held, n = [], 0
        for b in batches:
            ids, tokens = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(ids):
                k = min(window - n, len(ids) - at)
                held.append((ids[at : at + k], tokens[at : at + k]))
                n, at = n + k, at + k
                if n == window:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


AGAIN = "id long, n_tokens long, piece_no int, size long, container long"


def _repack(capacity: int, window: int):
    """Packs the rows of each group of windows again, in order of the group, by windows of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, no, held, n = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal no, held, n
            t = pa.Table.from_batches(held).combine_chunks()
            box = pack_window(t["size"].to_numpy(), capacity) + (1 << 62) + (int(grp) << 32) + (no << 20)
            no, held, n = no + 1, [], 0
            return t.select(["id", "n_tokens", "piece_no", "size"]).append_column("container", pa.array(box)).to_batches()[0]

        for b in batches:
            g = b.column("grp").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if g[lo] != grp:
                    if n:
                        yield flush()
                    grp, no = g[lo], 0
                while lo < hi:
                    k = min(window - n, hi - lo)
                    held.append(b.slice(lo, k))
                    n, lo = n + k, lo + k
                    if n == window:
                        yield flush()
        if n:
            yield flush()

    return run


def pack(df: DataFrame, row_id: Column, tokens: Column, capacity: int = CAPACITY, window: int = WINDOW, keep_fill: float = 0.98, merge: int = 64) -> DataFrame:
    """(id, n_tokens, piece_no, size, container, oversized): every item and its container."""
    tasks = max(1, -(-df.count() // (TASK_WINDOWS * window)))
    items = df.select(row_id.cast("long").alias("id"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))
    items = items.select(F.coalesce("id", F.lit(-(2**63) + 1)).alias("id"), "n_tokens")
    spread = items.repartition(tasks).sortWithinPartitions("id", "n_tokens")
    first = materialise(spread.mapInArrow(_pack(capacity, window, keep_fill), SCHEMA))
    done, poor = first.where("container <> -2"), first.where("container = -2")
    # windows are numbered over all tasks: one row a task
    per = first.groupBy("part").agg((F.max("win") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.select(F.col("part").alias("p"), before.alias("base"))
    grouped = poor.join(base, F.col("part") == F.col("p")).withColumn("grp", F.floor((F.col("base") + F.col("win")) / merge))
    # in a fixed order, so that a task that runs again packs alike
    again = grouped.repartition(max(1, -(-tasks * TASK_WINDOWS // merge)), "grp").sortWithinPartitions("grp", "id", "piece_no", "n_tokens")
    second = again.select("id", "n_tokens", "piece_no", "size", "grp").mapInArrow(_repack(capacity, window), AGAIN)
    every = done.select("id", "n_tokens", "piece_no", "size", "container").unionByName(second)
    box = F.when(F.col("container") >= 0, F.col("container"))
    return every.select(F.when(F.col("id") != -(2**63) + 1, F.col("id")).alias("id"), "n_tokens", "piece_no", "size", box.alias("container"), (F.col("n_tokens") > capacity).alias("oversized"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, tokens, the least number of containers that could hold them, the share of room used and the fullest container."""
    box = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("size").alias("used"))
    return box.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / F.lit(capacity)).alias("least_containers"),
        F.try_divide(F.sum("used"), F.count(F.lit(1)) * capacity).alias("fill"), F.max("used").alias("fullest"),
    )
