"""The chain decides what is seen; it can be stored and grown; keys may be text."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from merloom.llm import seen


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(11)
    keys = [int(x) for x in r.integers(0, 400, 3000)]
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, key long").repartition(6).cache()


def truth(rows):
    first: dict = {}
    for i, k in sorted(rows.collect()):
        first.setdefault(k, i)
    return {i: i > first[k] for i, k in rows.collect()}


def test_without_a_working_chain_nothing_is_found(spark, rows, monkeypatch):
    monkeypatch.setattr(seen, "CHUNK_ROWS", 100)
    want = truth(rows)
    assert {x.id: x.seen for x in seen.seen_before(rows, F.col("id"), F.col("key")).collect()} == want

    def broken(capacity, bound, save):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                cols = [b.column(c) for c in ("id", "ord", "key", "state", "bucket", "blob")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([0.0] * b.num_rows)], names=["id", "ord", "key", "state", "bucket", "blob", "bound"])

        return run

    monkeypatch.setattr(seen, "_answer", broken)
    got = {x.id: x.seen for x in seen.seen_before(rows, F.col("id"), F.col("key")).collect()}
    assert got != want and sum(got.values()) < sum(want.values())
    assert all(want[i] for i, s in got.items() if s)


@pytest.fixture
def short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "40")
    yield
    spark.conf.set(name, old)


def test_wrong_answers_are_found(spark, rows, short_batches):
    a = seen.answered(rows, F.col("id"), F.col("key"), capacity=8, bound=0.6, buckets=2)
    got = seen.confirmed(a).collect()
    assert {x.id: x.seen for x in got} == truth(rows)
    assert sum(x.said_seen and not x.seen for x in got) > 5


@pytest.mark.parametrize("save_twice", [False, True])
def test_a_stored_chain_answers_and_grows(spark, rows, save_twice):
    old = spark.createDataFrame([(k,) for k in range(100, 200)], "key long")
    more = spark.createDataFrame([(k,) for k in range(300, 350)], "key long")
    h = seen.remember(old, F.col("key"), capacity=8, buckets=4)
    assert h.count() > 4 and h.select("bucket").distinct().count() == 4
    known = set(range(100, 200))
    if save_twice:
        h, known = seen.remember(more, F.col("key"), history=h, capacity=8), known | set(range(300, 350))
    got = {x.id: x for x in seen.seen_before(rows, F.col("id"), F.col("key"), history=h, capacity=8).collect()}
    want = truth(rows)
    assert len(got) == len(want) and all(got[i].said_seen for i, s in want.items() if s)
    assert all(got[i].said_seen for i, k in rows.collect() if k in known)
    new = [i for i, k in rows.collect() if k not in known and not want[i]]
    assert sum(got[i].said_seen for i in new) <= len(new) * 0.02 + 1


def test_a_chain_of_no_rows(spark):
    none = spark.createDataFrame([], "id long, key long")
    h = seen.remember(none, F.col("key"))
    assert h.count() == 0
    assert seen.seen_before(none, F.col("id"), F.col("key"), history=h).count() == 0


def test_text_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(seen, "CHUNK_ROWS", 100)
    text = rows.select("id", F.when(F.col("key") > 5, F.concat(F.lit("key "), F.col("key").cast("string"))).alias("key"))
    base = spark.createDataFrame([("key 7",), (None,)], "k string")
    got = {x.id: (x.key, x.seen) for x in seen.seen_before(text, F.col("id"), F.col("key"), base, F.col("k")).collect()}
    want, keys = truth(rows), dict(rows.collect())
    assert {i: s for i, (_, s) in got.items()} == {i: keys[i] > 5 and (s or keys[i] == 7) for i, s in want.items()}
    assert Counter(k for k, _ in got.values())[None] == sum(k <= 5 for k in keys.values())
