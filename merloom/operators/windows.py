"""Letter windows of sequences (row generators).

``kmer_windows`` translates and windows whole Arrow batches with numpy: bases
are coded, every codon of every offset is looked up once, and the packed codes
of all windows are twelve shifted sums over the batch. Sequences longer than a
tile are cut into tiles that overlap by one window less one step, so memory is
bounded however long a sequence is. ``translate_native`` is the same
translation as a pure column expression.

Cases: null or empty sequences give no windows; reads whose padded length does
not exceed one window and one letter give none (the short-read rule); letters
are taken in upper case; DNA letters other than ACGT become Z and every codon
with one becomes ``_``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merloom.functions.codec import H64, codon_letter, codon_table

TILE = 3 * 100_000
_BASE = np.full(256, 5, np.int64)
for _i, _c in enumerate("ACTGX"):
    _BASE[ord(_c)] = _i
    _BASE[ord(_c.lower())] = _i
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCATGCA")


def codon_lookup(table: dict[str, str] | None = None) -> np.ndarray:
    """Letter code of each base triple, bases coded A C T G X other = 0..5."""
    table = table or codon_table()
    out = np.zeros(216, np.int64)
    names = "ACTGXZ"
    for i in range(216):
        t = names[i // 36] + names[i // 6 % 6] + names[i % 6]
        letter = "_" if "Z" in t else table.get(t, "^")
        out[i] = ord(letter) & 31
    return out


def reverse_complement_bytes(seq: bytes) -> bytes:
    return seq.translate(_COMPLEMENT)[::-1]


def window_count(n: int, kind: str, frames: int, h: int, side: str, min_k: int) -> tuple[int, int]:
    """(padding letters, windows) of a sequence of ``n`` letters."""
    if n == 0:
        return 0, 0
    if kind == "protein":
        if side == "reference":
            return h - 1, n
        pad = max(h - min_k, h - n)
        size = n + pad
        return pad, size - h + 1 if size > h + 1 else 0
    if side == "reference":
        pad, span = 3 * (h - 1), 3 * h
        last = n + pad - span
        return pad, 0 if last < 0 else (last // 3 + 1 if frames == 1 else last + 1)
    pad = max(3 * (h - min_k), 3 * h - n)
    size = n + pad
    if frames == 1:
        return pad, size // 3 - h + 1 if size // 3 > h + 1 else 0
    return pad, size - 3 * h + 1 if size > 3 * h + 1 else 0


def count_column(n: Column, kind: str = "dna", frames: int = 3, h: int = H64, min_k: int = 7) -> Column:
    """Windows of a read of ``n`` letters, as ``window_count`` has them, without making them."""
    if kind == "protein":
        size, span, strands = n + F.greatest(F.lit(h - min_k), h - n), F.lit(h), 1
    else:
        size, span, strands = n + F.greatest(F.lit(3 * (h - min_k)), 3 * h - n), F.lit(3 * h), 2 if frames == 6 else 1
        if frames == 1:
            size, span = F.floor(size / 3), F.lit(h)
    return F.when((n > 0) & (size > span + 1), (size - span + 1) * strands).otherwise(0).cast("long")


def _tiles(seq: bytes, pad: bytes, n_windows: int, step: int, span: int) -> Iterator[tuple[int, bytes, int]]:
    """(first position, letters, windows) pieces of one padded sequence."""
    whole = seq + pad
    per = TILE // 3
    for w in range(0, n_windows, per):
        k = min(per, n_windows - w)
        at = w * step
        yield at, whole[at : at + (k - 1) * step + span], k


class _Windower:
    def __init__(self, kind: str, frames: int, h: int, side: str, min_k: int, table: dict[str, str] | None):
        self.kind, self.frames, self.h, self.side, self.min_k = kind, frames, h, side, min_k
        self.lookup = codon_lookup(table)
        self.step = 3 if kind == "dna" and frames == 1 else 1
        self.stride = 3 if kind == "dna" else 1
        self.span = h * self.stride

    def pieces(self, rows: Sequence[str | None]) -> Iterator[tuple[int, int, int, bytes, int]]:
        """(row, strand, first position, letters, windows)."""
        for i, s in enumerate(rows):
            if not s:
                continue
            b = s.encode("ascii", "replace")
            if self.kind == "protein":
                b = b.upper().replace(b"*", b"[")
            for strand in range(2 if self.frames == 6 else 1):
                seq = reverse_complement_bytes(b) if strand else b
                pad, n = window_count(len(seq), self.kind, self.frames, self.h, self.side, self.min_k)
                for at, letters, k in _tiles(seq, (b"X" if self.kind == "dna" else b"^") * pad, n, self.step, self.span):
                    yield i, strand, at, letters, k

    def codes(self, part: list[tuple[int, int, int, bytes, int]]) -> tuple[np.ndarray, ...]:
        """Row, strand, position and letter matrix source of all windows of some pieces."""
        size = np.array([len(p[3]) for p in part])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        raw = np.frombuffer(b"".join(p[3] for p in part) + b"\0" * self.span, np.uint8)
        if self.kind == "dna":
            c = _BASE[raw]
            letters = self.lookup[c[:-2] * 36 + c[1:-1] * 6 + c[2:]]
        else:
            letters = raw.astype(np.int64) & 31
        k = np.array([p[4] for p in part])
        own = np.repeat(np.arange(len(part)), k)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
        at = start[own] + nth * self.step
        row = np.array([p[0] for p in part])[own]
        strand = np.array([p[1] for p in part], np.int32)[own]
        pos = (np.array([p[2] for p in part])[own] + nth * self.step).astype(np.int32)
        return row, strand, pos, letters, at

    def packed(self, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(self.h):
            out = (out << 5) | letters[at + i * self.stride]
        return out

    def text(self, letters: np.ndarray, at: np.ndarray) -> pa.Array:
        m = np.stack([letters[at + i * self.stride] for i in range(self.h)], 1).astype(np.uint8) | 64
        flat = pa.py_buffer(np.ascontiguousarray(m).tobytes())
        offsets = pa.py_buffer((np.arange(len(at) + 1) * self.h).astype(np.int32).tobytes())
        return pa.StringArray.from_buffers(len(at), offsets, flat)


def kmer_windows(df: DataFrame, seq: Column, keep: Sequence[str], kind: str = "dna", frames: int = 3, h: int = H64, side: str = "read", min_k: int = 7, table: dict[str, str] | None = None, as_text: bool | None = None) -> DataFrame:
    """(keep..., strand, pos, code bigint | kmer string): every window of every sequence.

    ``code`` holds h <= 12 letters; more letters (the 128-bit index) come as text.
    """
    text = h > H64 if as_text is None else as_text
    if h > H64 and not text:
        raise ValueError("codes hold at most 12 letters")
    fields = [df.schema[k] for k in keep]
    out = T.StructType([*fields, T.StructField("strand", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.StringType()) if text else T.StructField("code", T.LongType())])
    names = out.names
    n_keep = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Windower(kind, frames, h, side, min_k, table)

        def emit(b: pa.RecordBatch, part: list) -> pa.RecordBatch:
            row, strand, pos, letters, at = w.codes(part)
            value = w.text(letters, at) if text else pa.array(w.packed(letters, at))
            idx = pa.array(row)
            return pa.RecordBatch.from_arrays([*(b.column(i).take(idx) for i in range(n_keep)), pa.array(strand), pa.array(pos), value], names=names)

        for b in batches:
            part, n = [], 0
            for p in w.pieces(b.column(n_keep).to_pylist()):
                part.append(p)
                n += p[4]
                if n >= TILE:
                    yield emit(b, part)
                    part, n = [], 0
            if part:
                yield emit(b, part)

    return df.select(*keep, seq.alias("__seq")).mapInArrow(run, out)


def drop_unknown(windows: DataFrame, h: int = H64) -> DataFrame:
    """Windows without ``_`` (a codon with a foreign letter)."""
    if "kmer" in windows.columns:
        return windows.where(~F.contains("kmer", F.lit("_")))
    bad = F.lit(False)
    for i in range(h):
        bad = bad | (F.shiftright("code", 5 * i).bitwiseAND(F.lit(31).cast("long")) == 31)
    return windows.where(~bad)


def translate_native(dna: Column, table: dict[str, str] | None = None) -> Column:
    """Letters of the codons at every offset of a cleaned sequence, as one string, in column expressions only."""
    codons = F.regexp_extract_all(dna, F.lit("(?=([A-Z]{3}))"), F.lit(1))
    return F.array_join(F.transform(codons, lambda c: codon_letter(c, table)), "")


def in_one_frame(dna: Column, table: dict[str, str] | None = None) -> Column:
    """The protein of the first frame."""
    codons = F.regexp_extract_all(dna, F.lit("([A-Z]{3})"), F.lit(1))
    return F.array_join(F.transform(codons, lambda c: codon_letter(c, table)), "")


def open_frames(df: DataFrame, dna: Column, keys: Sequence[str]) -> DataFrame:
    """(keys..., start, stop): for every ATG the first stop codon in its frame more than three bases on.

    Start and stop codons become rows; the nearest stop is a growing window
    minimum over one sequence and frame, from the end.
    """
    rows = df.select(*keys, dna.alias("dna")).where(F.length("dna") >= 3)
    rows = rows.select(*keys, "dna", F.explode(F.sequence(F.lit(1), F.length("dna") - 2)).alias("i"))
    rows = rows.select(*keys, "i", F.expr("substring(dna, i, 3)").alias("x")).where(F.col("x").isin("ATG", "TAA", "TAG", "TGA"))
    w = Window.partitionBy(*keys, F.col("i") % 3).orderBy((-F.col("i"))).rangeBetween(Window.unboundedPreceding, -6)
    near = rows.withColumn("stop", F.min(F.when(F.col("x") != "ATG", F.col("i"))).over(w))
    return near.where("x = 'ATG' and stop is not null").select(*keys, F.col("i").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def every_nth_dropped(windows: DataFrame, percent: float, keys: Sequence[str]) -> DataFrame:
    """Windows of each sequence and strand without ``percent`` % of them, evenly spaced.

    Positions are dense within a sequence, so no sort is needed: the n-th
    window is ``pos + 1`` (three frames).
    """
    step = 100.0 / percent
    rn = F.col("pos") + 1
    hit = F.floor(F.ceil(rn / F.lit(step)) * F.lit(step)) == rn
    return windows.where(~hit)
