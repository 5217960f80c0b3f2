import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from merloom.operators import value_frequency as vf


def table(n=5000, seed=2):
    """A third of the rows under one key, nulls in every column, repeated rows."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        key = None if r.random() < 0.02 else 7 if r.random() < 0.34 else r.randrange(300)
        value = None if r.random() < 0.05 else r.choice([0, -5, 3, r.randrange(10**12), r.randrange(50)])
        rows.append((key, value, None if r.random() < 0.05 else r.randrange(4), "x"))
    return rows


def test_totals_modes_percentiles(spark):
    rows = table()
    df = spark.createDataFrame(rows, "key long, value long, freq long, rows string").withColumnRenamed("rows", "bucket")
    v = vf.value_frequencies(df, F.col("key"), F.col("value"))
    by = defaultdict(list)
    for k, x, _, _ in rows:
        by[k].append(x)
    got = {x.key: x for x in vf.key_totals(v).collect()}
    assert set(got) == set(by)
    for k, xs in by.items():
        assert (got[k].rows, got[k].total, got[k].n_distinct) == (len(xs), len(xs), len({x for x in xs if x is not None}))
    for x in vf.key_modes(v).collect():
        c = Counter(y for y in by[x.key] if y is not None)
        best = min(c, key=lambda y: (-c[y], y)) if c else None
        assert x.mode == best and x.mode_freq == (c[best] if c else None)
    for x in vf.key_percentiles(v, [0.01, 0.5, 0.9, 1.0]).collect():
        xs = sorted(y for y in by[x.key] if y is not None)
        import math

        assert x.value == xs[max(1, math.ceil(len(xs) * x.p)) - 1], (x, xs)


def test_weights(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 5, None), (1, 6, 3), (None, None, 2)], "k long, v long, w long")
    v = vf.value_frequencies(df, F.col("k"), F.col("v"), F.col("w"))
    got = {(x.key): (x.rows, x.total, x.n_distinct) for x in vf.key_totals(v).collect()}
    assert got == {1: (3, 13, 2), None: (1, 2, 0)}


def test_empty(spark):
    df = spark.createDataFrame([], "k long, v long")
    v = vf.value_frequencies(df, F.col("k"), F.col("v"))
    assert vf.key_totals(v).count() == vf.key_modes(v).count() == vf.key_percentiles(v, [0.5]).count() == 0


def test_no_stage_gathers_the_rows_of_a_key(spark):
    """A hot key reaches the second shuffle as its distinct values only."""
    df = spark.range(20000).select(F.lit(1).cast("long").alias("k"), (F.col("id") % 10).alias("v"))
    v = vf.value_frequencies(df, F.col("k"), F.col("v"))
    assert v.count() == 10
