"""Coherence of whole records: only windows that may match seven letters and more leave their record.

The short prefixes of the index are few (23 letters can occur in a read), so
which of them it holds is a bit map of bounded size that every task has. A further
map of bits by remainder finds the windows that may match one letter more; these
are joined exactly. Each record is then windowed once more, beside the longer
matches that came back to it, and its clusters are summed in place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merloom.functions.codec import H64, codon_table
from merloom.operators import index
from merloom.operators.identify import longest_of
from merloom.operators.windows import TILE, _Windower
from merloom.session import materialise

#: codes of the letters that windows of reads can have; padding ends every match
LETTERS = sorted({ord(c) & 31 for c in codon_table().values()} | {31})
#: an exact map has at most so many bits; the map by remainder has as many as its prime
EXACT, PRIME = 1 << 28, 134_217_689
#: Spark makes bit maps in pieces of so many bits
PIECE = 32_768


def _number(k: int) -> Column:
    """The first k letters of ``code`` as a number; null where a letter can't be in a read."""
    rank = F.array(*[F.lit(LETTERS.index(c) if c in LETTERS else None).cast("long") for c in range(32)])
    out = F.lit(0).cast("long")
    for i in range(1, k + 1):
        out = out * len(LETTERS) + F.get(rank, index.letter(F.col("code"), i).cast("int"))
    return out


def _bits(codes: DataFrame, number: Column, size: int, once: bool) -> np.ndarray:
    """The map of the numbers that occur, at most ``size`` of them; pieces are made in one place if ``once``."""
    x = codes.select((number + 1).alias("x")).where("x is not null").select(F.bitmap_bucket_number("x").alias("b"), F.bitmap_bit_position("x").alias("p"))
    rows = (x.repartition("b") if once else x).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros((size // PIECE + 1, PIECE // 8), np.uint8)
    for b, m in rows.collect():
        out[b - 1] = np.frombuffer(m, np.uint8)
    return out.reshape(-1)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class _Records:
    """The windows of the records of a batch, a part at a time, with the longest match that the maps give."""

    def __init__(self, min_k: int, exact: dict[int, np.ndarray], more: int, maybe: np.ndarray | None):
        self.w, self.exact, self.more, self.maybe = _Windower("dna", 6, H64, "read", min_k, None), exact, more, maybe
        self.rank = np.full(32, -1, np.int64)
        self.rank[LETTERS] = np.arange(len(LETTERS))

    def parts(self, seqs: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, strand, pos, len, may match longer, letters, at) in order of row, strand and position."""
        part, n = [], 0
        for p in self.w.pieces(seqs.to_pylist()):
            part.append(p)
            n += p[4]
            if n >= TILE:
                yield self._part(part)
                part, n = [], 0
        if part:
            yield self._part(part)

    def _part(self, part: list) -> tuple[np.ndarray, ...]:
        row, strand, pos, letters, at = self.w.codes(part)
        rank = self.rank[letters]
        number, known, size = np.zeros(len(at), np.int64), np.ones(len(at), bool), np.zeros(len(at), np.int64)
        maybe = known
        for k in range(1, max([*self.exact, self.more]) + 1):
            r = rank[at + 3 * (k - 1)]
            known &= r >= 0
            number = number * len(LETTERS) + r
            if k in self.exact:
                found = np.flatnonzero(known)
                found = found[_has(self.exact[k], number[found])]
                size[found] = k
                maybe = np.zeros(len(at), bool)
                maybe[found] = True
        live = np.zeros(0, np.int64)
        if self.more:
            live = np.flatnonzero(known & maybe)
            live = live[_has(self.maybe, number[live] % PRIME)]
        return row, strand, pos, size, live, letters, at


def coherence_of(records: DataFrame, seq: Column, idx: DataFrame, keys: Sequence[str], min_k: int, max_k: int) -> DataFrame:
    """(keys..., coherence) of the DNA records, one row each, that match: ``coherence`` of their ``longest_matches`` in six frames."""
    spark, keys = records.sparkSession, list(keys)
    recs = materialise(records.select(*keys, seq.alias("__seq")))
    codes = materialise(idx.select("code").where(f"code >= 0 and code < {1 << 5 * H64}").distinct())
    ks = [k for k in range(min_k, max_k + 1) if len(LETTERS) ** k <= EXACT]
    exact = {k: _bits(codes, _number(k), len(LETTERS) ** k, len(LETTERS) ** k > 1 << 24) for k in ks}
    more = max([min_k, *[k + 1 for k in ks]])
    more = more if more <= max_k else 0
    maps = spark.sparkContext.broadcast((exact, _bits(codes, _number(more) % PRIME, PRIME, True) if more else None))
    fields = [records.schema[k] for k in keys]
    n_keys = len(keys)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _Records(min_k, maps.value[0], more, maps.value[1])
        for b in batches:
            for row, strand, pos, _, live, letters, at in r.parts(b.column(n_keys)):
                own = pa.array(row[live])
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(own) for i in range(n_keys)), pa.array(strand[live]), pa.array(pos[live]), pa.array(r.w.packed(letters, at[live]))], names=[*keys, "strand", "pos", "code"])

    def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _Records(min_k, maps.value[0], 0, None)
        for b in batches:
            place, longer = _longer(b.column(n_keys + 1))
            best, hit = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            open_ = (-1, 0, -1, 0)
            for row, strand, pos, size, *_ in r.parts(b.column(n_keys)):
                if not len(row):
                    continue
                here = ((row * 2 + strand) << 32) | pos
                lo, hi = np.searchsorted(place, [here[0], here[-1] + 1])
                size[np.searchsorted(here, place[lo:hi])] = longer[lo:hi]
                m = np.flatnonzero(size)
                hit[row[m]] = True
                open_ = _best_clusters(row[m], row[m] * 2 + strand[m], pos[m].astype(np.int64), size[m], open_, best)
            at = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n_keys)), pa.array(best[hit])], names=[*keys, "coherence"])

    out = T.StructType([*fields, T.StructField("coherence", T.DoubleType())])
    if more:
        strand, pos, code = T.StructField("strand", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("code", T.LongType())
        live = materialise(recs.mapInArrow(survivors, T.StructType([*fields, strand, pos, code])))
        found = longest_of(live, codes, keys, more, max_k)
        at = F.shiftleft(F.col("strand").cast("long"), 37).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 5)).bitwiseOR(F.col("len").cast("long"))
        per = found.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.collect_list(at).alias("__longer"))
        on = [recs[k].eqNullSafe(per[f"__{k}"]) for k in keys]
        recs = recs.join(per.hint("merge"), on, "left").select(*keys, "__seq", "__longer")
    else:
        recs = recs.withColumn("__longer", F.lit(None).cast("array<bigint>"))
    return recs.mapInArrow(clusters, out)


def _longer(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """(place, len) of the longer matches of a batch in order of place: row, strand and position."""
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    place = ((row * 2 + (v >> 37)) << 32) | ((v >> 5) & 0xFFFFFFFF)
    order = np.argsort(place)
    return place[order], (v & 31)[order]


def _best_clusters(row: np.ndarray, side: np.ndarray, pos: np.ndarray, size: np.ndarray, open_: tuple, best: np.ndarray) -> tuple:
    """Raises ``best`` of each row to its best cluster among matches in order; ``open_`` is what the matches before end with: side, end, overlap, how often.

    A cluster only gains by what follows, so one that is still open may count already.
    """
    if not len(row):
        return open_
    end = pos + size
    last = np.concatenate([[open_[1]], end[:-1]])
    joined = (side == np.concatenate([[open_[0]], side[:-1]])) & (pos <= last)
    overlap = np.where(joined, np.where(end < last, size, last - pos), -1)
    first = ~joined
    first[0] = True
    start = np.flatnonzero(first)
    top = np.maximum.reduceat(overlap, start)
    n = np.add.reduceat((overlap == top[np.cumsum(first) - 1]).astype(np.int64), start)
    if joined[0] and open_[2] >= top[0]:
        n[0] = open_[3] + (n[0] if open_[2] == top[0] else 0)
        top[0] = open_[2]
    some = top >= 0
    np.maximum.at(best, row[start[some]], top[some] + 1.0 - 1.0 / n[some])
    return side[-1], end[-1], top[-1], n[-1]
