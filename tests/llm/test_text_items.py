"""Text keys, and summaries that are too small."""

import pytest
from pyspark.sql import functions as F

from merloom.llm import heavy, membership


def test_frequent_texts(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    got = heavy.frequent_items(df.repartition(5), F.col("k"), 1, 100).collect()
    assert [(x.key, x.rows) for x in got] == [("hot", 1000)]


def test_too_few_counters_raise(spark, monkeypatch):
    short = spark.createDataFrame([(1, 5, 0, 60, 1000)], "key long, count long, err long, least long, n long")
    monkeypatch.setattr(heavy, "summary", lambda *a: short)
    df = spark.range(1000).select((F.col("id") % 500).alias("k"))
    with pytest.raises(Exception, match="too few counters"):
        heavy.frequent_items(df, F.col("k"), 5, 100).collect()


def test_a_new_day_is_merged(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (None, 10)], "i long, c long")
    b = spark.createDataFrame([(1, 12), (2, 10), (3, 12), (3, None)], "i long, c long")
    sets = lambda x: membership.member_sets(x, F.col("i"), F.col("c"))
    both = membership.merge_sets(sets(a), sets(b))
    assert {x.ident: x.pattern for x in both.collect()} == {1: [10, 11, 12], 2: [10], 3: [12]}
    whole = membership.patterns(a.unionByName(b), F.col("i"), F.col("c"))
    assert {(tuple(x.pattern), x.n) for x in membership.patterns_of(both).collect()} == {(tuple(x.pattern), x.n) for x in whole.collect()}
