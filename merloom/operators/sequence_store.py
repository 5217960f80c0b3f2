"""Ordered-data operators: sorts with ranks, zips, consecutive deduplication, lookups, queues, matrices.

Ranks are dense positions in a global order. Rows are spread by range, every
range is numbered by itself and shifted by the sizes of the ranges before it,
so no task holds more than one range. The ranged rows are written once
(``materialise``), since the choice of ranges is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merloom.session import materialise


def ranked(df: DataFrame, *order: Column, name: str = "rank", start: int = 1) -> DataFrame:
    """``df`` with its position in the global order; ties get different positions, so give a full order."""
    at = [o for o in order]
    cols = df.columns
    ranged = materialise(df.repartitionByRange(*at).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # one row each range
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offs = sizes.select(F.col("__part").alias("p"), before.alias("base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*at))
    x = ranged.withColumn("__own", own).join(offs, F.col("__part") == F.col("p"))
    return x.select(*cols, (F.col("base") + F.col("__own") + (start - 1)).alias(name))


def shuffled(df: DataFrame, row_id: Column, seed: int = 1, name: str = "rank") -> DataFrame:
    """A random order that depends on the seed and the ids only."""
    return ranked(df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))), F.col("__h"), row_id, name=name).drop("__h")


def zipped(*parts: DataFrame, on: str = "rank") -> DataFrame:
    """Sequences side by side by position; the shortest decides the length."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, on)
    return out


def unique_consecutive(df: DataFrame, value: str, on: str = "rank") -> DataFrame:
    """Rows whose value differs from that of the row before (null equals null); the first row stays."""
    prev = df.select((F.col(on) + 1).alias(on), F.col(value).alias("__prev"), F.lit(True).alias("__has"))
    x = df.join(prev, on, "left")
    return x.where(F.col("__has").isNull() | ~F.col(value).eqNullSafe(F.col("__prev"))).drop("__prev", "__has")


def is_sorted(df: DataFrame, value: str, on: str = "rank") -> DataFrame:
    """One row: whether values never fall along the positions."""
    prev = df.select((F.col(on) + 1).alias(on), F.col(value).alias("__prev"))
    return df.join(prev, on).agg((F.count_if(F.col(value) < F.col("__prev")) == 0).alias("sorted"))


def find_first(df: DataFrame, cond: Column, on: str = "rank") -> DataFrame:
    """The first row that meets a condition, or none."""
    return df.where(cond).orderBy(on).limit(1)


def between(df: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    """Range lookup low <= key < high; on range-stored tables it reads the files in question only."""
    return df.where((F.col(key) >= low) & (F.col(key) < high))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order: every task keeps n rows, the driver merges them."""
    return df.orderBy(*order).limit(n)


def sums(df: DataFrame, key: str, value: Column, name: str = "total") -> DataFrame:
    """Sum by key."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


def stack_replay(ops: DataFrame, on: str = "rank") -> DataFrame:
    """(rank, value) left on a stack after a log of pushes (op = 'push', value) and pops (op = 'pop').

    Depth is a running sum; a push survives if no later depth falls below its
    own. One log is one sequence: the window is over the log, which is given
    as ``log`` where there are several.
    """
    keys = ["log"] if "log" in ops.columns else [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy(on)
    d = ops.withColumn("depth", F.sum(F.when(F.col("op") == "push", 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    later = Window.partitionBy(*keys).orderBy(F.desc(on)).rowsBetween(Window.unboundedPreceding, -1)
    low = F.min("depth").over(later)
    return d.withColumn("low", low).where((F.col("op") == "push") & (F.col("low").isNull() | (F.col("low") >= F.col("depth")))).drop("low", "depth")


# -- matrices in coordinate form (i, j, v) -----------------------------------


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def matrix_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products of matching entries, summed map-side by place of the result."""
    x = a.select("i", F.col("j").alias("m"), F.col("v").alias("x")).join(b.select(F.col("i").alias("m"), "j", F.col("v").alias("y")), "m")
    return x.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matrix_of(df: DataFrame, row: str, values: str) -> DataFrame:
    """Coordinate form of rows with an array column."""
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def gram(a: DataFrame) -> DataFrame:
    """Transpose times the matrix itself."""
    return matrix_multiply(matrix_transpose(a), a)


def suffix_array(chars: DataFrame) -> DataFrame:
    """(pos, place) of the suffixes of a text given as (pos, c): prefix doubling until all ranks differ, ranks written after each round."""
    n = chars.count()
    r = chars.select("pos", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("c")).alias("r")) if n < 2 else _dense(chars.select("pos", F.col("c").alias("a"), F.lit(0).alias("b")))
    step = 1
    while step < n and r.agg(F.max("r")).first()[0] < n:
        nxt = r.select((F.col("pos") - step).alias("pos"), F.col("r").alias("b"))
        r = _dense(r.withColumnRenamed("r", "a").join(nxt, "pos", "left").select("pos", "a", F.coalesce("b", F.lit(0)).alias("b")))
        step *= 2
    return r.select("pos", F.col("r").alias("place"))


def _dense(x: DataFrame) -> DataFrame:
    """Dense ranks of the distinct (a, b) pairs."""
    keys = ranked(x.select("a", "b").distinct(), F.col("a"), F.col("b"), name="r")
    return materialise(x.join(keys, ["a", "b"]).select("pos", "r"))


def generate(spark: SparkSession, n: int, value: Column, parts: int | None = None) -> DataFrame:
    """(rank, value) from an expression over the position ``id``."""
    return spark.range(n, numPartitions=parts).select((F.col("id") + 1).alias("rank"), value.alias("value"))


def transform(df: DataFrame, names: Sequence[str], value: Column) -> DataFrame:
    """Each row's columns ``names`` and one new value."""
    return df.select(*names, value.alias("value"))
