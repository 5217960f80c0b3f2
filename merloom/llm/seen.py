"""Has this key been seen before? Scalable Bloom chains with a known compounded error bound.

A chain is a list of Bloom layers. A layer takes new keys until its fill
threshold (half of its bits set, reached at its design capacity); then a layer
``growth`` times larger with an error rate ``tightening`` times smaller is
added. With rates p0, p0*t, p0*t^2, ... the chance that a new key is called
seen stays below p0 / (1 - t) however long the history grows.

Distribution: keys are hashed to ``buckets``, each with one chain, and the rows
of a bucket pass its chain in order of arrival. Before that shuffle every chunk
of input rows is reduced to the first row of each key in the chunk; the other
rows of the chunk are certainly seen and travel spread by their own id, so a
key that holds a third of all rows costs its bucket one row a chunk.

Stored history: chains are rows (bucket, layer, blob) that can be written and
given to a later run, which loads the layers of a bucket before its first row
and grows them on; the keys themselves need not be read again.

The chain decides: a row it calls new is new, as it has no false negatives. Only
rows it calls seen are checked, and of these only the first of each key in
question: it is a wrong answer unless an earlier row (one the chain called new)
or a known key holds its key. The check joins keys, never whole rows, and what
it finds wrong is a small table.

Keys may be bigint or text; text is hashed for the chain and compared as text
elsewhere.

Cases: a null key is never seen and enters no chain; rows with a null id come
after all others; of rows with the same id and key none is earlier than the
other; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merloom.session import materialise, small

CHUNK_ROWS = 1 << 19
BUCKETS = 128
LAST = np.iinfo(np.int64).max
#: places in the order before every row: layers of a stored chain, then known keys
FIRST_LAYER, KNOWN = -(2**63) + 1, -(2**62)
#: states of a row on its way
NEW, MAYBE, REPEAT, BASE, NO_KEY, LAYER = 0, 1, 2, 3, 4, 5


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply), vectorised."""
    with np.errstate(over="ignore"):
        z = x.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class BloomLayer:
    """One Bloom filter with room for ``capacity`` keys at error rate ``rate``."""

    def __init__(self, capacity: int, rate: float):
        self.capacity, self.rate, self.used = capacity, rate, 0
        self.hashes = max(1, math.ceil(-math.log2(rate)))
        # at half-filled bits the rate is 2 ** -hashes
        self.m = max(64, math.ceil(capacity * self.hashes / math.log(2)))
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)

    _HEAD = struct.Struct("<qdq")

    def to_bytes(self) -> bytes:
        return self._HEAD.pack(self.capacity, self.rate, self.used) + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> BloomLayer:
        capacity, rate, used = cls._HEAD.unpack_from(blob)
        out = cls(capacity, rate)
        out.bits, out.used = np.frombuffer(blob, np.uint8, offset=cls._HEAD.size).copy(), used
        return out

    def _places(self, h1: np.ndarray, h2: np.ndarray, j: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h1 + np.uint64(j) * h2 + np.uint64(j * j * j)) % np.uint64(self.m)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        left = np.arange(len(h1))
        for j in range(self.hashes):
            p = self._places(h1[left], h2[left], j)
            left = left[(self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(left):
                break
        out = np.zeros(len(h1), bool)
        out[left] = True
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for j in range(self.hashes):
            p = self._places(h1, h2, j)
            np.bitwise_or.at(self.bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        self.used += len(h1)


class BloomChain:
    """Geometrically larger layers with tightening error rates."""

    def __init__(self, capacity: int = 1 << 15, bound: float = 1e-3, growth: int = 2, tightening: float = 0.5):
        self.bound, self.growth, self.tightening = bound, growth, tightening
        self.layers = [BloomLayer(capacity, bound * (1 - tightening))]

    @staticmethod
    def hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mix64(keys, 1), mix64(keys, 2) | np.uint64(1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h1, h2 = self.hashed(keys)
        found = np.zeros(len(keys), bool)
        for layer in reversed(self.layers):  # the largest layers hold most keys
            left = np.flatnonzero(~found)
            if not len(left):
                break
            found[left] = layer.contains(h1[left], h2[left])
        return found

    def add(self, keys: np.ndarray) -> None:
        h1, h2 = self.hashed(keys)
        at = 0
        while at < len(keys):
            top = self.layers[-1]
            if top.used >= top.capacity:
                top = BloomLayer(top.capacity * self.growth, top.rate * self.tightening)
                self.layers.append(top)
            n = min(len(keys) - at, top.capacity - top.used)
            top.add(h1[at : at + n], h2[at : at + n])
            at += n

    def compounded_bound(self) -> float:
        """Chance that a key never added is called seen, over the layers so far."""
        keep = 1.0
        for x in self.layers:
            keep *= 1 - x.rate
        return 1 - keep

    def seen_then_add(self, keys: np.ndarray) -> np.ndarray:
        """Answers for keys in order of arrival; new ones are added."""
        seen = self.contains(keys)
        fresh = np.flatnonzero(~seen)
        if len(fresh):
            first = np.sort(fresh[np.unique(keys[fresh], return_index=True)[1]])
            again = np.ones(len(keys), bool)
            again[first] = False
            seen = seen | again
            self.add(keys[first])
        return seen


def _numpy(col: pa.ChunkedArray | pa.Array, null: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.fill_null(null).to_numpy(zero_copy_only=False)


def _mark_repeats(chunk_rows: int):
    """Chunks of (id, ord, key, hash, state): rows whose key has a smaller ord in the same chunk become REPEAT."""

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        state = _numpy(t["state"], NEW).copy()
        live = np.flatnonzero(state != NO_KEY)
        if len(live):
            order = _numpy(t["ord"], LAST)[live]
            if pa.types.is_integer(t.schema.field("key").type):
                same = np.unique(_numpy(t["key"], 0)[live], return_inverse=True)[1]
            else:  # text is compared as text, not by its hash
                same = _numpy(pc.dictionary_encode(t["key"].take(pa.array(live))).combine_chunks().indices, 0)
            least = np.full(int(same.max()) + 1, LAST, np.int64)
            np.minimum.at(least, same, order)
            state[live[order > least[same]]] = REPEAT
        t = t.set_column(t.schema.get_field_index("state"), "state", pa.array(state, pa.int32()))
        spread = np.where((state == REPEAT) | (state == NO_KEY), _numpy(t["ord"], LAST), _numpy(t["hash"], 0))
        yield from t.append_column("spread", pa.array(spread, pa.int64())).to_batches(max_chunksize=65536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= chunk_rows:
                yield from emit(held)
                held, n = [], 0
        if held:
            yield from emit(held)

    return run


def _answer(capacity: int, bound: float, save: bool):
    """Rows in order of (bucket, ord) through the chain of their bucket; with ``save`` its layers follow its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: BloomChain | None = None
        bucket: int | None = None
        loaded: list[BloomLayer] = []

        def layers(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            if not save or chain is None:
                return
            n = len(chain.layers)
            cols = {"state": pa.array([LAYER] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "ord": pa.array([FIRST_LAYER + i for i in range(n)]), "blob": pa.array([x.to_bytes() for x in chain.layers])}
            yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            own = _numpy(b.column("bucket"), 0)
            state, keys = _numpy(b.column("state"), NEW).copy(), _numpy(b.column("hash"), 0)
            bounds = np.zeros(len(own))
            gone = state == LAYER
            schema = pa.schema([*[f for f in b.schema if f.name != "hash"], pa.field("bound", pa.float64())])
            cut = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for lo, hi in zip(cut, cut[1:]):
                if own[lo] != bucket:
                    yield from layers(schema)
                    bucket, chain, loaded = int(own[lo]), None, []
                at = lo
                while at < hi and state[at] == LAYER:
                    loaded.append(BloomLayer.from_bytes(b.column("blob")[at].as_py()))
                    at += 1
                live = at + np.flatnonzero((state[at:hi] == NEW) | (state[at:hi] == BASE))
                if chain is None and (at < hi or loaded):
                    chain = BloomChain(capacity, bound)
                if loaded and at < hi:
                    chain.layers, loaded = loaded, []
                if len(live):
                    said = chain.seen_then_add(keys[live])
                    mark = live[said]
                    state[mark[state[mark] == NEW]] = MAYBE
                if chain is not None:
                    bounds[at:hi] = chain.compounded_bound()
            if chain is not None and loaded:  # a bucket that got no row keeps its layers
                chain.layers = list(loaded)
            out = [pa.array(state, pa.int32()) if f.name == "state" else pa.array(bounds) if f.name == "bound" else b.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(out, schema=schema).filter(pa.array(~gone))
        if schema is not None:
            yield from layers(schema)

    return run


def answered(df: DataFrame, row_id: Column, key: Column, base: DataFrame | None = None, base_key: Column | None = None, history: DataFrame | None = None, capacity: int = 1 << 12, bound: float = 1e-3, buckets: int = BUCKETS, save: bool = False) -> DataFrame:
    """(id, ord, key, state, bucket, blob, bound) as the chains answer, written once; with ``save`` also the layers of every chain."""
    if history is not None:
        kept = history.agg(F.max("buckets")).first()[0]  # one number
        buckets = kept or buckets
    state = F.when(F.col("key").isNull(), NO_KEY).otherwise(NEW).cast("int")
    rows = df.select(row_id.cast("long").alias("id"), key.alias("key"))
    if not isinstance(rows.schema["key"].dataType, T.StringType):
        rows = rows.select("id", F.col("key").cast("long").alias("key"))
    kind = rows.schema["key"].dataType.simpleString()
    hashed = F.col("key") if kind == "bigint" else F.xxhash64("key")
    rows = rows.select("id", F.coalesce("id", F.lit(int(LAST))).alias("ord"), "key", hashed.alias("hash"), state.alias("state"))
    marked = rows.mapInArrow(_mark_repeats(CHUNK_ROWS), f"id long, ord long, key {kind}, hash long, state int, spread long")
    bucket = F.pmod(F.xxhash64("spread"), F.lit(buckets)).cast("int").alias("bucket")
    every = marked.select("id", "ord", "key", "hash", "state", bucket, F.lit(None).cast("binary").alias("blob"))
    none = lambda t: F.lit(None).cast(t)
    if base is not None:
        known = base.select(base_key.cast(kind).alias("key")).where(F.col("key").isNotNull()).distinct().withColumn("hash", hashed).withColumn("spread", F.col("hash"))
        every = every.unionByName(known.select(none("long").alias("id"), F.lit(KNOWN).cast("long").alias("ord"), "key", "hash", F.lit(BASE).cast("int").alias("state"), bucket, none("binary").alias("blob")))
    if history is not None:
        layer = history.select(none("long").alias("id"), (F.lit(FIRST_LAYER) + F.col("layer")).alias("ord"), none(kind).alias("key"), none("long").alias("hash"), F.lit(LAYER).cast("int").alias("state"), "bucket", "blob")
        every = every.unionByName(layer)
    own = every.repartition("bucket").sortWithinPartitions("bucket", "ord", "hash")
    return materialise(own.mapInArrow(_answer(capacity, bound, save), f"id long, ord long, key {kind}, state int, bucket int, blob binary, bound double"))


def chain_of(answers: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(buckets, bucket, layer, blob): the chains of a run of ``answered`` with ``save``, to be written and given on as ``history``."""
    return answers.where(F.col("state") == LAYER).select(F.lit(buckets).alias("buckets"), "bucket", (F.col("ord") - F.lit(FIRST_LAYER)).cast("int").alias("layer"), "blob")


def confirmed(answers: DataFrame) -> DataFrame:
    """(id, key, said_seen, seen, bound) of every row: the chain's answer, and the same less what the check found wrong."""
    fresh = answers.where(F.col("state").isin(NEW, BASE)).select(F.col("key").alias("fresh"), F.col("ord").alias("since"))
    maybe = answers.where(F.col("state") == MAYBE)
    first = maybe.groupBy("key").agg(F.min("ord").alias("first"))
    # the first row of a key that was called seen, with no earlier row of that key
    earlier = first.join(fresh, (F.col("key") == F.col("fresh")) & (F.col("since") < F.col("first")), "left_anti")
    wrong = small(materialise(earlier.select(F.col("key").alias("wrong_key"), F.col("first").alias("wrong_ord"))))
    hit = maybe.join(wrong, (F.col("key") == F.col("wrong_key")) & (F.col("ord") == F.col("wrong_ord")), "left")
    rest = answers.where(F.col("state").isin(NEW, REPEAT, NO_KEY))
    again = F.col("state") == REPEAT
    return rest.select("id", "key", again.alias("said_seen"), again.alias("seen"), "bound").unionByName(hit.select("id", "key", F.lit(True).alias("said_seen"), F.col("wrong_key").isNull().alias("seen"), "bound"))


def seen_before(df: DataFrame, row_id: Column, key: Column, base: DataFrame | None = None, base_key: Column | None = None, history: DataFrame | None = None, capacity: int = 1 << 12, bound: float = 1e-3, buckets: int = BUCKETS) -> DataFrame:
    """(id, key, said_seen, seen, bound) of every row.

    ``base`` holds keys known before the first row, ``history`` a stored chain.
    ``said_seen`` is the chain's answer, ``seen`` the same without the wrong
    answers that the check found, ``bound`` the chain's error bound at the
    time. Keys known by ``history`` alone cannot be confirmed: take ``said_seen``.
    """
    return confirmed(answered(df, row_id, key, base, base_key, history, capacity, bound, buckets))


def remember(df: DataFrame, key: Column, history: DataFrame | None = None, capacity: int = 1 << 12, bound: float = 1e-3, buckets: int = BUCKETS) -> DataFrame:
    """A stored chain of the keys of a table, grown from ``history`` where given."""
    a = answered(df, F.lit(0), key, history=history, capacity=capacity, bound=bound, buckets=buckets, save=True)
    return chain_of(a, history.agg(F.max("buckets")).first()[0] or buckets if history is not None else buckets)


def error_report(answers: DataFrame) -> DataFrame:
    """One row: rows, rows called seen, rows truly seen, wrong answers of each kind, their rate among new rows and the bound."""
    new = F.col("key").isNotNull() & ~F.col("seen")
    wrong = F.col("said_seen") & ~F.col("seen")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    out = answers.agg(
        F.count(F.lit(1)).alias("n_rows"), n(F.col("said_seen")).alias("n_said_seen"), n(F.col("seen")).alias("n_seen"),
        n(wrong).alias("n_wrong_seen"), n(F.col("seen") & ~F.col("said_seen")).alias("n_wrong_new"), n(new).alias("n_new"), F.max("bound").alias("error_bound"),
    )
    return out.withColumn("wrong_rate", F.try_divide(F.col("n_wrong_seen"), F.col("n_new")))
