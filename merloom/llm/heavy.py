"""Most frequent items among billions: space-saving summaries merged in a tree, then an exact second pass.

Each task keeps ``m`` counters. A chunk of rows is counted exactly, which is a
space-saving summary whose least counter is 0, and merged into the summary of
the task: an item missing from one side adds that side's least counter to its
count and error; the ``m`` largest stay. For every kept item
``count - err <= true <= count``, and every item not kept occurs at most
``least`` times. Task summaries are merged with the same rule, ``fan_in`` at a
time by level, so no task reads more than ``fan_in * m`` counters. With
``m > 1 / share`` every item holding ``share`` of the rows is among the at most
``m`` candidates; these (bounded by ``m``) are broadcast to count them exactly.

Keys may be bigint or text: text is summarised by its 64-bit hash and counted
exactly as text. If the greatest count an item outside the summary may have
reaches the share, the query fails rather than miss an item.

Cases: null keys are counted as rows but are no item; equal counts are ordered
by key; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "part long, key long, count long, err long, least long, n long"
CHUNK_ROWS = 1 << 19


class Summary:
    """Space-saving counters as sorted arrays."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, err: np.ndarray, least: int = 0, n: int = 0):
        self.keys, self.count, self.err, self.least, self.n = keys, count, err, least, n

    @classmethod
    def exact(cls, rows: np.ndarray, n: int) -> Summary:
        keys, count = np.unique(rows, return_counts=True)
        return cls(keys, count.astype(np.int64), np.zeros(len(keys), np.int64), 0, n)

    def merge(self, other: Summary, m: int) -> Summary:
        keys = np.union1d(self.keys, other.keys)
        count, err = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for s in (self, other):
            at = np.searchsorted(keys, s.keys)
            have = np.zeros(len(keys), bool)
            have[at] = True
            count[at] += s.count
            err[at] += s.err
            count[~have] += s.least
            err[~have] += s.least
        out = Summary(keys, count, err, self.least + other.least, self.n + other.n)
        return out.cut(m)

    def cut(self, m: int) -> Summary:
        if len(self.keys) <= m:
            return self
        order = np.lexsort((self.keys, -self.count))
        keep = np.sort(order[:m])
        # an item dropped here, or dropped before, occurs at most this often
        least = max(self.least, int(self.count[order[m]]))
        return Summary(self.keys[keep], self.count[keep], self.err[keep], least, self.n)

    def batch(self, part: int) -> pa.RecordBatch:
        k = len(self.keys)
        if not k:  # rows without any key still count
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([None], pa.int64()), pa.array([0]), pa.array([0]), pa.array([self.least]), pa.array([self.n])], names=["part", "key", "count", "err", "least", "n"])
        full = lambda v: pa.array(np.full(k, v, np.int64))
        return pa.RecordBatch.from_arrays([full(part), pa.array(self.keys), pa.array(self.count), pa.array(self.err), full(self.least), full(self.n)], names=["part", "key", "count", "err", "least", "n"])

    @classmethod
    def of(cls, t: pa.Table) -> Summary:
        least, n = t["least"][0].as_py(), t["n"][0].as_py()
        t = t.filter(t["key"].is_valid()).sort_by("key").combine_chunks()
        num = lambda c: t[c].to_numpy()
        return cls(num("key"), num("count").copy(), num("err").copy(), least, n)


def _summarise(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: Summary | None = None
        held, n = [], 0
        for b in batches:
            held.append(b.column(0))
            n += b.num_rows
            if n >= CHUNK_ROWS:
                s = Summary.exact(pa.chunked_array(held).drop_null().to_numpy(), n)
                total, held, n = s.cut(m) if total is None else total.merge(s, m), [], 0
        if n:
            s = Summary.exact(pa.chunked_array(held).drop_null().to_numpy(), n)
            total = s.cut(m) if total is None else total.merge(s, m)
        if total is not None:
            yield total.batch(TaskContext.get().partitionId())

    return run


def _merge_group(m: int, divide: int):
    def run(t: pa.Table) -> pa.Table:
        parts = t["part"].to_numpy()
        total: Summary | None = None
        for p in np.unique(parts):
            s = Summary.of(t.filter(pa.array(parts == p)))
            total = s if total is None else total.merge(s, m)
        return pa.Table.from_batches([total.batch(int(parts.min()) // divide)])

    return run


def summary(df: DataFrame, key: Column, m: int = 2048, fan_in: int = 16, levels: int = 4) -> DataFrame:
    """(key, count, err, least, n) of the whole table: the merged summary.

    ``fan_in ** levels`` tasks are covered by the tree (65,536 by default); the
    last level merges whatever is left.
    """
    out = df.select(key.cast("long").alias("key")).mapInArrow(_summarise(m), SCHEMA)
    for level in range(levels):
        last = level == levels - 1
        group = F.lit(0).cast("long") if last else F.floor(F.col("part") / fan_in)
        out = out.groupBy(group.alias("g")).applyInArrow(_merge_group(m, fan_in), SCHEMA)
    return out.drop("part")


def frequent_items(df: DataFrame, key: Column, share_num: int, share_den: int, m: int = 2048, fan_in: int = 16, levels: int = 4) -> DataFrame:
    """(key, rows, count, err, n): items held by at least share_num/share_den of all rows, counted exactly, beside their summary counts."""
    if m * share_num <= share_den:
        raise ValueError("m counters must be more than 1 / share")
    rows = df.select(key.alias("key"))
    text = isinstance(rows.schema["key"].dataType, T.StringType)
    rows = rows.select(F.xxhash64("key").alias("code"), "key") if text else rows.select(F.col("key").cast("long").alias("code"), F.col("key").cast("long").alias("key"))
    s = summary(rows, F.when(F.col("key").isNotNull(), F.col("code")), m, fan_in, levels)
    # an item outside the summary occurs at most ``least`` times: the summary must have room for the share
    lost = F.raise_error(F.lit("too few counters for the share: take a greater m")).cast("boolean")
    kept = F.when(F.col("least") * share_den >= F.col("n") * share_num, lost).otherwise(F.col("count") * share_den >= F.col("n") * share_num)
    likely = s.where(kept).where(F.col("key").isNotNull()).withColumnRenamed("key", "likely")
    # at most m rows of 40 bytes are broadcast
    hit = rows.where(F.col("key").isNotNull()).join(F.broadcast(likely), F.col("code") == F.col("likely"))
    exact = hit.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("count").alias("count"), F.max("err").alias("err"), F.max("n").alias("n"))
    return exact.where(F.col("rows") * share_den >= F.col("n") * share_num)
