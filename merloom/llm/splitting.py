"""Splitting oversized records at natural boundaries with a fixed overlap.

A record is the chunks of one (read_id, mate) in the order of chunk_no. Its
letters are all characters but line breaks, tabs and blanks; positions count
letters. Every chunk is first reduced to its letter count and the places of
its boundaries, so a shuffle carries positions, never text, and a hot chunk
(delivered many times) is reduced to one before records are put together.
Chunks then stream through a task in the order of their record; what is held
of a record are the offsets of its boundaries as numbers (8 bytes each).

Cuts are chosen by dynamic programming over boundary positions: least number
of forced cuts, then least size imbalance, subject to the length limit. The
first piece holds at most ``limit`` letters; every other piece begins
``overlap`` letters before the cut that ends the piece before it, so
consecutive cuts are at most ``limit - overlap`` apart. A record is ``forced``
if the program had to choose a cut that is no boundary.

Cases: null text counts as empty; chunks delivered twice count once (of
differing copies the one read last, then the greater text); null chunk
numbers sort first; a null kind is taken as ``dna``; records within the limit
are not split; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = {"dna": 35, "protein": 11}
MIN_RUN = 5
_BLANK = re.compile(r"[\r\n\t ]+")
_RUN = re.compile(r"[Nn]+")

FEATURES = "n int, brk array<int>, run_start array<int>, run_end array<int>, stops array<int>"


def chunk_features(text: str, kind: str) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Letters, line breaks, N runs (long ones and those at an end) and stops of one chunk, as letter offsets."""
    brk, letters, n = [], [], 0
    at = 0
    for m in _BLANK.finditer(text):
        n += m.start() - at
        letters.append(text[at : m.start()])
        at = m.end()
        if "\n" in m.group() or "\r" in m.group():
            brk.append(n)
    letters.append(text[at:])
    n += len(text) - at
    plain = "".join(letters)
    starts, ends, stops = [], [], []
    if kind == "protein":
        stops = [i + 1 for i, c in enumerate(plain) if c == "*"] if "*" in plain else []
    else:
        for m in _RUN.finditer(plain):
            if m.end() - m.start() >= MIN_RUN or m.start() == 0 or m.end() == n:
                starts.append(m.start())
                ends.append(m.end())
    return n, brk, starts, ends, stops


def _features(text: Column, kind: Column) -> Column:
    @F.pandas_udf(FEATURES)
    def features(text, kind):
        import pandas as pd

        rows = [chunk_features(t or "", k or "dna") for t, k in zip(text, kind)]
        return pd.DataFrame(rows, columns=["n", "brk", "run_start", "run_end", "stops"])

    return features(text, kind)


class Places:
    """Boundaries of one record, gathered chunk by chunk as letter offsets."""

    def __init__(self):
        self.total, self.at, self.starts, self.ends = 0, [], [], []

    def add(self, n: int, brk: np.ndarray, run_start: np.ndarray, run_end: np.ndarray, stops: np.ndarray) -> None:
        for x in (brk, stops):
            if len(x):
                self.at.append(np.asarray(x, np.int64) + self.total)
        if len(run_start):
            self.starts.append(np.asarray(run_start, np.int64) + self.total)
            self.ends.append(np.asarray(run_end, np.int64) + self.total)
        self.total += n

    def inner(self) -> np.ndarray:
        at = list(self.at)
        if self.starts:
            s, e = np.concatenate(self.starts), np.concatenate(self.ends)
            apart = s[1:] != e[:-1]  # a run may go on in the next chunk
            s, e = s[np.r_[True, apart]], e[np.r_[apart, True]]
            long = e - s >= MIN_RUN
            at += [s[long], e[long]]
        p = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
        return p[(p > 0) & (p < self.total)]


def record_boundaries(chunks: list[dict], kind: str) -> tuple[int, np.ndarray]:  # noqa: ARG001
    """Letters of a record and its sorted inner boundaries, from chunk features in order."""
    out = Places()
    for c in chunks:
        out.add(*(c["f"][k] for k in ("n", "brk", "run_start", "run_end", "stops")))
    return out.total, out.inner()


def best_cuts(total: int, natural: np.ndarray, limit: int, overlap: int) -> tuple[list[int], bool]:
    """Cut positions and whether all are natural: least forced cuts, and of these cuttings the least imbalance.

    The program goes over the natural boundaries. From one to a later one a
    hop takes as many forced cuts as its width asks for; evenly spaced they
    are the least unbalanced of all places they may have, so every position is
    offered though none is listed. A hop over a boundary never needs fewer
    forced cuts than one that stops there: the forced cuts of the gaps between
    neighbours add up to the least possible, and a hop is open if it asks for
    no more than the gaps it covers. Less the letters that forced cuts cover, open
    hops are those of at most one span, so the program looks back one span.
    """
    if overlap >= limit:
        raise ValueError("the overlap must be less than the limit")
    if total <= limit:
        return [], True
    span = limit - overlap
    natural = np.asarray(natural, np.int64)
    natural = natural[(natural >= overlap) & (natural < total)]  # the next piece begins `overlap` letters before its cut
    # the first piece repeats nothing: it is as if it began at `overlap` with the room of any other
    pos = np.concatenate([[overlap], natural, [total]])
    forced = np.concatenate([[0], np.cumsum(np.maximum(-(-np.diff(pos) // span) - 1, 0))])
    slack = pos - forced * span
    back_to = np.searchsorted(slack, slack - span)
    pieces = max(2, -(-(total - overlap) // span))
    want = (total + (pieces - 1) * overlap) / pieces - overlap
    cost, back = np.zeros(len(pos)), np.zeros(len(pos), np.int64)
    for j in range(1, len(pos)):
        i = min(int(back_to[j]), j - 1)
        width = pos[j] - pos[i:j]
        if forced[j] == forced[i]:
            c = cost[i:j] + ((width - want) / limit) ** 2
        else:
            parts = forced[j] - forced[i:j] + 1
            q, r = width // parts, width % parts
            c = cost[i:j] + (r * (q + 1 - want) ** 2 + (parts - r) * (q - want) ** 2) / limit**2
        b = int(np.argmin(c))
        cost[j], back[j] = c[b], i + b
    cuts, ok, j = [], True, len(pos) - 1
    while j:
        i = int(back[j])
        n = int(forced[j] - forced[i])
        ok = ok and n == 0
        cuts += [int(pos[i] + (pos[j] - pos[i]) * t // (n + 1)) for t in range(n, 0, -1)]
        if i:
            cuts.append(int(pos[i]))
        j = i
    return cuts[::-1], ok


def pieces_of(total: int, cuts: list[int], overlap: int) -> list[tuple[int, int]]:
    ends = [*cuts, total]
    return [(0 if i == 0 else ends[i - 1] - overlap, e) for i, e in enumerate(ends)]


def _split(limit: int, overlaps: dict[str, int]):
    """Chunks in order of (read_id, mate, chunk_no); a record is held as the offsets of its boundaries until its last chunk."""

    def finish(key: tuple, numbers: list, sizes: list[int], kinds: set, places: Places) -> dict | None:
        if places.total <= limit:
            return None
        kind = max(kinds) if kinds else "dna"
        overlap = overlaps.get(kind, 0)
        natural = places.inner()
        cuts, ok = best_cuts(places.total, natural, limit, overlap)
        pieces = pieces_of(places.total, cuts, overlap)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        spans = []
        for k, (s, e) in enumerate(pieces):
            for i in range(max(0, int(np.searchsorted(starts, s, "right")) - 1), len(sizes)):
                if starts[i] >= e:
                    break
                f, t = max(s, int(starts[i])) - int(starts[i]), min(e, int(starts[i + 1])) - int(starts[i])
                if t > f:
                    spans.append({"piece_no": k, "chunk_no": numbers[i], "from": f, "to": t})
        n_forced = int((~np.isin(cuts, natural)).sum()) if not ok else 0
        return {"read_id": key[0], "mate": key[1], "kind": kind, "n_letters": places.total, "cut": "natural" if ok else "forced", "n_forced": n_forced, "pieces": [{"piece_no": k, "start": s, "end": e} for k, (s, e) in enumerate(pieces)], "spans": spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, sizes, kinds, places, rows, held = None, [], [], set(), Places(), [], 0
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False)
            lists = []
            for c in ("brk", "run_start", "run_end", "stops"):
                col = b.column(c)
                lists.append((col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)))
            for i, (r, m, no, kind) in enumerate(zip(*(b.column(c).to_pylist() for c in ("read_id", "mate", "chunk_no", "kind")))):
                if key != (r, m):
                    if key is not None and (row := finish(key, numbers, sizes, kinds, places)):
                        rows.append(row)
                        held += len(row["pieces"])
                    if held > 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
                    key, numbers, sizes, kinds, places = (r, m), [], [], set(), Places()
                numbers.append(no)
                sizes.append(int(n[i]))
                if kind is not None:
                    kinds.add(kind)
                places.add(int(n[i]), *(v[o[i] : o[i + 1]] for o, v in lists))
        if key is not None and (row := finish(key, numbers, sizes, kinds, places)):
            rows.append(row)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


_ARROW = pa.schema(
    [
        ("read_id", pa.int64()), ("mate", pa.int32()), ("kind", pa.string()), ("n_letters", pa.int64()), ("cut", pa.string()), ("n_forced", pa.int32()),
        ("pieces", pa.list_(pa.struct([("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
        ("spans", pa.list_(pa.struct([("piece_no", pa.int32()), ("chunk_no", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))),
    ]
)
SPLIT_SCHEMA = "read_id long, mate int, kind string, n_letters long, cut string, n_forced int, pieces array<struct<piece_no int, start long, end long>>, spans array<struct<piece_no int, chunk_no int, `from` int, `to` int>>"


def _latest(chunks: DataFrame, what: Column) -> DataFrame:
    """One row for each (read_id, mate, chunk_no): of copies the one read last, then the greater hash of the text."""
    slim = chunks.select("read_id", "mate", "chunk_no", what.alias("v"), F.struct(F.col("read_at"), F.xxhash64("seq").alias("h")).alias("o"))
    return slim.groupBy("read_id", "mate", "chunk_no").agg(F.max_by("v", "o").alias("v"))


def split_records(chunks: DataFrame, limit: int = LIMIT, overlaps: dict[str, int] | None = None) -> DataFrame:
    """One row for each record of more than ``limit`` letters: its pieces, how they were cut and the chunk spans they take."""
    one = _latest(chunks, F.struct(_features(F.col("seq"), F.col("kind")).alias("f"), F.col("kind")))
    flat = one.select("read_id", "mate", "chunk_no", F.col("v.kind").alias("kind"), *[F.col(f"v.f.{c}").alias(c) for c in ("n", "brk", "run_start", "run_end", "stops")])
    own = flat.repartition("read_id", "mate").sortWithinPartitions("read_id", "mate", "chunk_no")
    return own.mapInArrow(_split(limit, overlaps or OVERLAP), SPLIT_SCHEMA)


def piece_texts(chunks: DataFrame, splits: DataFrame) -> DataFrame:
    """(read_id, mate, piece_no, start, end, text): the letters of every piece, put together from the chunks it spans."""
    letters = F.regexp_replace(F.coalesce("seq", F.lit("")), "[\\r\\n\\t ]+", "")
    text = _latest(chunks, letters).select(F.col("read_id").alias("r"), F.col("mate").alias("m"), F.col("chunk_no").alias("c"), F.col("v").alias("letters"))
    s = splits.select("read_id", "mate", F.explode("spans").alias("s")).select("read_id", "mate", "s.*")
    same = (F.col("read_id") == F.col("r")) & F.col("mate").eqNullSafe(F.col("m")) & F.col("chunk_no").eqNullSafe(F.col("c"))
    part = s.join(text, same).select("read_id", "mate", "piece_no", "chunk_no", F.substring("letters", F.col("from") + 1, F.col("to") - F.col("from")).alias("t"))
    whole = part.groupBy("read_id", "mate", "piece_no").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "t"))).alias("ts"))
    return whole.select("read_id", "mate", "piece_no", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("text"))
