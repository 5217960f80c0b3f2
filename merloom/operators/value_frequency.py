"""Per-key results without imbalance when few keys hold most rows.

Value-frequency compression: rows are first counted by (key, value), which
spreads a hot key over as many tasks as it has values and is combined before
the shuffle; only the weighted values are then gathered by key. Every later
step is either algebraic (combined map-side again) or works on the values of
one (key, bucket), so no task ever holds the rows of one key.

Nulls: a null key is a group of its own (callers drop it where null is no
key); null values count in ``total`` and never as a distinct value, mode or
percentile. Rows with a null weight weigh 0. An empty table gives no rows.
Columns of the input other than those named are never read, so their names
may clash with anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_frequencies(df: DataFrame, key: Column, value: Column, weight: Column | None = None) -> DataFrame:
    """(key, value, rows, freq): one row for each distinct pair; ``freq`` is the sum of weights or the rows."""
    w = F.lit(1).cast("long") if weight is None else F.coalesce(weight, F.lit(0)).cast("long")
    slim = df.select(key.alias("key"), value.alias("value"), w.alias("w"))
    return slim.groupBy("key", "value").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("freq"))


def key_totals(vf: DataFrame) -> DataFrame:
    """(key, rows, total, n_distinct): exact totals and distinct values of every key."""
    return vf.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("freq").alias("total"), F.count("value").alias("n_distinct"))


def key_modes(vf: DataFrame) -> DataFrame:
    """(key, mode, mode_freq): the value of greatest weight, of ties the smallest; null where a key has only null values."""
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("freq")).alias("neg"), F.col("value").alias("value")))).alias("best")
    return vf.groupBy("key").agg(best).select("key", F.col("best.value").alias("mode"), (-F.col("best.neg")).alias("mode_freq"))


def _bucket(value: Column, bits: int) -> Column:
    """Order-keeping bucket of a number: sign, binary exponent and ``bits`` leading bits."""
    d = value.cast("double")
    a = F.abs(d)
    e = F.floor(F.log2(F.when(a > 0, a)))
    scale = F.pow(F.lit(2.0), e.cast("double"))
    # log2 may round up next to a power of two; the clamp keeps the order
    m = F.least(F.greatest(F.floor((a / scale - 1.0) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1))
    mag = F.coalesce((e + 1100) * (1 << bits) + m, F.lit(0)).cast("long")
    return F.when(d < 0, -mag).otherwise(mag)


def key_percentiles(vf: DataFrame, percents: Sequence[float], bits: int = 8) -> DataFrame:
    """(key, p, value): nearest-rank percentiles of numeric values, exact.

    Weights are summed in order-keeping buckets (at most ``2**bits`` for each
    power of two), the bucket that holds the wanted rank is found from the
    running sums over buckets, and only the distinct values of that bucket are
    sorted. Work is split by (key, bucket).
    """
    v = vf.where(F.col("value").isNotNull() & (F.col("freq") > 0)).withColumn("bucket", _bucket(F.col("value"), bits))
    sums = v.groupBy("key", "bucket").agg(F.sum("freq").alias("w"))
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("key")
    cum = sums.withColumn("upto", F.sum("w").over(run)).withColumn("n", F.sum("w").over(whole))
    ps = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(p)))).cast("long").alias("rank")) for p in percents])
    want = (
        cum.withColumn("t", F.explode(ps))
        .where((F.col("t.rank") <= F.col("upto")) & (F.col("t.rank") > F.col("upto") - F.col("w")))
        .select(F.col("key").alias("wk"), F.col("bucket").alias("wb"), F.col("t.p").alias("p"), (F.col("t.rank") - (F.col("upto") - F.col("w"))).alias("need"))
    )
    inside = v.join(want, F.col("key").eqNullSafe(F.col("wk")) & (F.col("bucket") == F.col("wb")))
    run2 = Window.partitionBy("key", "bucket", "p").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        inside.withColumn("run", F.sum("freq").over(run2))
        .where((F.col("run") >= F.col("need")) & (F.col("run") - F.col("freq") < F.col("need")))
        .select("key", "p", "value")
    )


def heavy_keys(totals: DataFrame, weight: str, of: Column, share_num: int, share_den: int) -> DataFrame:
    """Keys (null excluded) whose ``weight`` is at least share_num/share_den of ``of``, in whole numbers."""
    return totals.where(F.col("key").isNotNull() & (F.col(weight) * share_den >= of * share_num))
