"""Scores by an index of 25 letters without a row for each window.

Windows of one sequence overlap by all but one letter, and all prefixes of
``min_k`` letters and more of a window share its first ``min_k``. So a window goes
to the group of the least hash among the four-letter pieces of these, and as
windows side by side mostly share it, a run of them travels as one piece of
sequence. A group holds every window, of reads and of the index, that can match
one of its own: taxa are counted and scores summed within it, level by level only
while a prefix still has several continuations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.functions.codec import H64, H128
from merloom.operators.index import PAD_CODE
from merloom.operators.windows import _BASE, _tiles, codon_lookup, window_count

GROUPS, PIECE = 2048, 4
#: windows cut at a time, windows scored at a time, rows of a join at a time
CUT, SCORED, PAIRS = 1_000_000, 300_000, 4_000_000
READ, INDEX, UNKNOWN = 1, 2, 31
_NULL = np.iinfo(np.int64).min


def _columns(a: np.ndarray) -> bytes:
    """The bytes of numbers, the first of all before the second of all: near numbers compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8).T).tobytes()


def _numbers(b: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, n).T).view(np.int64).reshape(n)


def _groups(letters: np.ndarray, min_k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of letters side by side: the group of its window, and whether its first ``min_k`` letters hold an unknown one."""
    n = len(letters)
    piece = np.zeros(n, np.uint32)
    for i in range(PIECE):
        piece[: n - i] = (piece[: n - i] << 5) | letters[i:]
    piece = (piece + np.uint32(1)) * np.uint32(2654435761)
    piece ^= piece >> np.uint32(15)
    piece = piece * np.uint32(2246822519)
    piece ^= piece >> np.uint32(13)
    least, bad = piece.copy(), letters == UNKNOWN
    for i in range(1, min_k - PIECE + 1):
        np.minimum(least[: n - i], piece[i:], out=least[: n - i])
    out = bad.copy()
    for i in range(1, min_k):
        out[: n - i] |= bad[i:]
    return least % np.uint32(GROUPS), out


class _Cutter:
    """Runs of windows of many sequences, by group."""

    def __init__(self, min_k: int):
        self.min_k, self.lookup = min_k, codon_lookup().astype(np.uint8)

    def pieces(self, rows: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes, int]]:
        """(read, tax, role, bases, windows)."""
        read_null = rows.column(0).is_null().to_pylist()
        for read, none, tax, role, s in zip(rows.column(0).to_pylist(), read_null, rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist()):
            n = len(s) - 3 * self.min_k + 1 if s else 0
            if n <= 0:
                continue
            if not window_count(len(s), "dna", 3, H128, "read", self.min_k)[1]:
                role &= ~READ  # too short for a read, not for a reference
            if tax is None:
                role &= ~INDEX
            if role:
                for _, bases, k in _tiles(s.encode("ascii", "replace"), b"X" * (3 * (H128 - self.min_k)), n, 1, 3 * H128):
                    yield _NULL if none else read, tax or 0, role, bases, k

    def cut(self, part: list[tuple[int, int, int, bytes, int]]) -> pa.RecordBatch:
        size = np.array([len(p[3]) for p in part])
        start = np.cumsum(size) - size
        c = _BASE[np.frombuffer(b"".join(p[3] for p in part) + b"XX", np.uint8)]
        letters = self.lookup[c[:-2] * 36 + c[1:-1] * 6 + c[2:]]
        k = np.array([p[4] for p in part])
        owner = np.full(len(letters), -1, np.int32)
        owner[np.repeat(start - (np.cumsum(k) - k), k) + np.arange(k.sum())] = np.repeat(np.arange(len(part), dtype=np.int32), k)
        runs = []
        text = np.concatenate([letters[f::3] for f in range(3)])
        base = 0
        for f in range(3):
            own, side = owner[f::3], letters[f::3]
            group, bad = _groups(side, self.min_k)
            live = (own >= 0) & ~bad
            first = live.copy()
            first[1:] &= ~live[:-1] | (own[1:] != own[:-1]) | (group[1:] != group[:-1])
            at = np.flatnonzero(first)
            n = np.bincount(np.cumsum(first)[live] - 1, minlength=len(at))
            runs.append((group[at].astype(np.int32), base + at, n, own[at]))
            base += len(side)
        group, at, n, own = (np.concatenate(x) for x in zip(*runs))
        order = np.lexsort((own, group))
        group, at, n, own = group[order], at[order], n[order], own[order]
        read, tax = (np.array([p[i] for p in part], np.int64)[own] for i in (0, 1))
        role = np.array([p[2] for p in part], np.uint8)[own]
        cuts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
        blobs = []
        for i, j in zip(cuts, np.append(cuts[1:], len(group))):
            size = n[i:j] + H128 - 1
            where = np.repeat(at[i:j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            blobs.append(zlib.compress(b"".join((np.int64(j - i).tobytes(), _columns(n[i:j].astype(np.int64)), _columns(read[i:j]), _columns(tax[i:j]), role[i:j].tobytes(), text[where].tobytes())), 1))
        return pa.RecordBatch.from_arrays([pa.array(group[cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["grp", "runs"])


def _opened(blob: bytes) -> tuple[np.ndarray, ...]:
    b = zlib.decompress(blob)
    n = int(np.frombuffer(b, np.int64, 1)[0])
    number = lambda i: _numbers(b[8 + 8 * n * i : 8 + 8 * n * (i + 1)], n)
    return number(0), number(1), number(2), np.frombuffer(b, np.uint8, n, 8 + 24 * n), np.frombuffer(b, np.uint8, -1, 8 + 25 * n)


class _Sums:
    """Sums of weights and counts by key, added up whenever many are held."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, key: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        self.held.append((key, w, c))
        self.n += len(key)
        if self.n > PAIRS:
            one = self.total()
            # what stays held does not count: else every addition to many keys would add all up again
            self.held, self.n = [one], 0

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, w, c = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        u, inv = np.unique(key, return_inverse=True)
        return u, np.bincount(inv, w, len(u)), np.bincount(inv, c, len(u)).astype(np.int64)


def _scores(runs: list[tuple[np.ndarray, ...]], min_k: int, max_k: int) -> tuple[np.ndarray, ...]:
    """(read, tax, score, hits) of the windows of whole groups."""
    n, read, tax, role, letters = (np.concatenate(x) for x in zip(*runs))
    own = np.repeat(np.arange(len(n)), n)
    size = n + H128 - 1
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(n.sum())
    a, b, c = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), letters[at + H128 - 1]
    bad = c == UNKNOWN
    for i in range(H64):
        x, y = letters[at + i], letters[at + H64 + i]
        a, b = (a << 5) | x, (b << 5) | y
        bad |= (x == UNKNOWN) | (y == UNKNOWN)
    order = np.lexsort((c, b, a))
    a, b, c, own, bad = a[order], b[order], c[order], own[order], bad[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    kmer = np.cumsum(new) - 1
    a, b, c = a[new], b[new], c[new]
    taxa, of_tax = np.unique(tax, return_inverse=True)
    ids, of_read = np.unique(read, return_inverse=True)
    stored = (role[own] & INDEX > 0) & ~bad
    asked = role[own] & READ > 0
    i_kmer, i_tax = np.divmod(np.unique(kmer[stored] * len(taxa) + of_tax[own[stored]]), len(taxa))
    r, cnt = np.unique(kmer[asked] * len(ids) + of_read[own[asked]], return_counts=True)
    r_kmer, r_read = np.divmod(r, len(ids))

    def letter(k: int) -> np.ndarray:
        return c if k == H128 else (b >> (5 * (2 * H64 - k))) & 31

    sums = _Sums()
    for k in range(min_k, max_k + 1):
        if not len(r_kmer) or not len(i_kmer):
            break
        first = np.ones(len(a), bool)
        if k < H128:
            head = b >> (5 * (2 * H64 - k))
            first[1:] = (a[1:] != a[:-1]) | (head[1:] != head[:-1])
        prefix = np.cumsum(first) - 1
        n_prefix = prefix[-1] + 1
        # only prefixes of both sides go on
        both = (np.bincount(prefix[i_kmer], minlength=n_prefix) > 0) & (np.bincount(prefix[r_kmer], minlength=n_prefix) > 0)
        keep_i, keep_r = both[prefix[i_kmer]], both[prefix[r_kmer]]
        i_kmer, i_tax, r_kmer, r_read, cnt = i_kmer[keep_i], i_tax[keep_i], r_kmer[keep_r], r_read[keep_r], cnt[keep_r]
        # where one window is left of a prefix, all longer ones have the same taxa
        kmers = np.unique(np.concatenate([i_kmer, r_kmer]))
        alone = np.bincount(prefix[kmers], minlength=n_prefix) == 1
        weight, times = np.zeros(len(a)), np.zeros(len(a), np.int64)
        for j in range(k, max_k + 1):
            real = letter(j)[kmers] != PAD_CODE
            here = kmers[real & (alone[prefix[kmers]] | (j == k))]
            weight[here] += j * j / 625.0
            times[here] += 1
        pair = prefix[i_kmer] * len(taxa) + i_tax
        p_of, t_of = np.divmod(np.unique(pair), len(taxa))
        n_taxa = np.bincount(p_of, minlength=n_prefix)
        begin = np.cumsum(n_taxa) - n_taxa
        use = np.flatnonzero(times[r_kmer] > 0)
        many = n_taxa[prefix[r_kmer[use]]]
        done = np.cumsum(many)
        lo = 0
        while lo < len(use):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
            one, m = use[lo:hi], many[lo:hi]
            row = np.repeat(one, m)
            t = t_of[np.repeat(begin[prefix[r_kmer[one]]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            sums.add(r_read[row] * len(taxa) + t, cnt[row] * weight[r_kmer[row]] / np.repeat(m, m), cnt[row] * times[r_kmer[row]])
            lo = hi
        rest_i, rest_r = ~alone[prefix[i_kmer]], ~alone[prefix[r_kmer]]
        i_kmer, i_tax, r_kmer, r_read, cnt = i_kmer[rest_i], i_tax[rest_i], r_kmer[rest_r], r_read[rest_r], cnt[rest_r]
    key, score, hits = sums.total()
    of, t = np.divmod(key, len(taxa))
    return ids[of], taxa[t], score, hits


def long_scores(records: DataFrame, seq: Column, read: str, tax: str, min_k: int, max_k: int = H128) -> DataFrame:
    """(read, tax, score, hits): sums of all matches of ``min_k`` to ``max_k`` letters.

    A record with ``is_read`` asks, one with a taxon is part of the index, and one with both
    travels once. The index are the distinct 25-letter windows of each taxon without
    unknown letters, as ``read_scores`` of ``match`` has them.
    """
    if not H64 < min_k <= max_k <= H128:
        raise ValueError("long matches have 13 to 25 letters")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, part, n = _Cutter(min_k), [], 0
        for rows in batches:
            for p in cutter.pieces(rows):
                part.append(p)
                n += p[4]
                if n >= CUT:
                    yield cutter.cut(part)
                    part, n = [], 0
        if part:
            yield cutter.cut(part)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(runs: list) -> pa.RecordBatch:
            ids, taxa, w, hits = _scores(runs, min_k, max_k)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _NULL), pa.array(taxa, pa.int64()), pa.array(w, pa.float64()), pa.array(hits, pa.int64())], names=["__read", "__tax", "score", "hits"])

        runs, n, last = [], 0, None
        for rows in batches:
            for g, blob in zip(rows.column(0).to_pylist(), rows.column(1)):
                if g != last and n >= SCORED:
                    yield out(runs)
                    runs, n = [], 0
                last = g
                runs.append(_opened(blob.as_py()))
                n += int(runs[-1][0].sum())
        if runs:
            yield out(runs)

    role = F.when(F.col("is_read"), READ).otherwise(0) + F.when(F.col(tax).isNotNull(), INDEX).otherwise(0)
    cuts = records.select(F.col(read).cast("long"), F.col(tax).cast("long"), role.cast("int"), seq.alias("__seq")).mapInArrow(cut, "grp int, runs binary")
    rows = cuts.repartition("grp").sortWithinPartitions("grp").mapInArrow(score, "__read long, __tax long, score double, hits long")
    return rows.groupBy(F.col("__read").alias(read), F.col("__tax").alias(tax)).agg(F.sum("score").alias("score"), F.sum("hits").alias("hits"))
