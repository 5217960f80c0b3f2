"""Paths of any depth, and loops."""

import pytest

from merloom.operators import reports


def test_a_deep_path(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank")] + [(i, i - 1, "genus" if i == 3 else None) for i in range(2, 71)], "tax long, parent long, rank_name string")
    up = reports.ancestors(nodes, nodes.where("tax in (70, 2)"))
    assert sorted((x.tax, x.ancestor, x.depth) for x in up.collect()) == sorted([(70, a, 70 - a) for a in range(1, 71)] + [(2, 2, 0), (2, 1, 1)])
    assert {x.tax: x.upper for x in reports.lift(nodes, nodes.where("tax = 70"), "genus").collect()} == {70: 3}


def test_a_loop_raises(spark):
    nodes = spark.createDataFrame([(1, 1, None), (2, 3, None), (3, 4, None), (4, 2, None)], "tax long, parent long, rank_name string")
    with pytest.raises(ValueError, match="loop"):
        reports.ancestors(nodes, nodes)


def test_an_unknown_parent_ends_the_path(spark):
    nodes = spark.createDataFrame([(5, 9, None), (6, 5, None)], "tax long, parent long, rank_name string")
    assert sorted((x.tax, x.ancestor) for x in reports.ancestors(nodes, nodes).collect()) == [(5, 5), (6, 5), (6, 6)]
