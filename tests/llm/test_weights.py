"""Odd weights in a mix, and packing that follows the items."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from merloom.llm import mixing, packing


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
def test_weights_of_any_scale(spark, scale):
    w = F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 == 1, 0.0).when(F.col("id") % 10 == 2, -1.0).when(F.col("id") % 10 == 3, float("nan")).when(F.col("id") % 2 == 0, scale).otherwise(scale / 10)
    df = spark.range(4000).select("id", F.lit("a").alias("s"), F.lit(10).cast("long").alias("t"), w.cast("double").alias("w"))
    slim = mixing.slim(df, F.col("id"), F.col("s"), F.col("t"), F.col("w"))
    targets = lambda x: spark.createDataFrame([("a", x, 1)], "source string, target_share double, max_repeats int")
    some = [x.id for x in mixing.mix(slim, mixing.budgets(slim, targets(0.2))).collect()]
    assert len(some) == 800 and all(i % 10 > 3 for i in some) and sum(i % 2 == 0 for i in some) > 600
    most = [x.id for x in mixing.mix(slim, mixing.budgets(slim, targets(0.9))).collect()]
    assert len(most) == len(set(most)) == 3600 and sum(i % 10 > 3 for i in most) == 2400
    assert len(mixing.mix(slim, mixing.budgets(slim, targets(1.0))).collect()) == 4000


def test_groups_of_windows(spark):
    """Poor containers of every window are packed again with those of its group, whatever the number of tasks."""
    df = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(400)) + 300).alias("n"))
    old = packing.TASK_WINDOWS
    try:
        for windows in (1, 64):
            packing.TASK_WINDOWS = windows
            got = packing.pack(df, F.col("id"), F.col("n"), capacity=1000, window=50, merge=16).collect()
            room = defaultdict(int)
            for x in got:
                room[x.container] += x["size"]
            assert len(got) == 3000 and max(room.values()) <= 1000
            assert Counter(x.id for x in got).most_common(1)[0][1] == 1
    finally:
        packing.TASK_WINDOWS = old


def test_one_id_many_times(spark):
    df = spark.range(2000).select(F.lit(7).alias("id"), F.lit(300).alias("n"))
    got = packing.pack(df, F.col("id"), F.col("n"), capacity=1000, window=100).collect()
    room = defaultdict(int)
    for x in got:
        room[x.container] += x["size"]
    assert len(got) == 2000 and max(room.values()) <= 1000 and len(room) <= 2000 / 3 * 1.02 + 1
