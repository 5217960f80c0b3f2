"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a token budget: its target share of the mix. Complete epochs
of the source come first (at most ``max_repeats``); what is left of the budget
is filled by a weighted sample without replacement: documents get exponential
keys ``-ln(u) / weight`` with u from a hash of their id, are taken in
ascending order of key, and the prefix sum of their tokens is cut at the
budget.

Skew: the prefix sum of a source is never computed in one task. Keys fall
into order-keeping buckets, ``buckets`` for each power of two, so weights of
any scale spread alike; bucket totals give every bucket its offset, and rows
are summed within (source, bucket).

Names of sources are equal if they differ only in case and outer blanks.

Cases: documents with a null or unlisted source count in the total only;
documents of 0 tokens are used with the complete epochs and cost nothing; a
source without documents falls short; repeated rows are documents of their
own, ordered by id; a document whose weight is null, zero, negative or not a
number comes after all others of its source, in the order of its hash; empty
tables give no rows, or a report of shortfalls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.session import materialise, small

BUCKETS = 256
TAIL = 1 << 30  # buckets of documents without a weight


def source_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def quality_weight(chars: Column, tokens: Column) -> Column:
    """Sampling weight of a text in [0.05, 1]: damaged text needs more tokens for its characters."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.coalesce(F.try_divide(chars.cast("double"), tokens * F.lit(4.0)), F.lit(0.05))))


def _uniform(row_id: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of the id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_id), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def slim(docs: DataFrame, row_id: Column, source: Column, tokens: Column, weight: Column) -> DataFrame:
    """(id, src, tokens, weight): all the mix needs, written once since it is read three times."""
    return materialise(docs.select(row_id.cast("long").alias("id"), source_name(source).alias("src"), tokens.cast("long").alias("tokens"), weight.cast("double").alias("weight")))


def budgets(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row for each listed source: its tokens, budget, complete epochs and the rest.

    ``total`` is the size of the mix in tokens; by default that of all documents.
    """
    size = F.lit(total) if total is not None else docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    have = docs.groupBy("src").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"))
    t = targets.where(F.col("source").isNotNull()).select("source", source_name(F.col("source")).alias("key"), F.col("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    out = t.join(have, F.col("key") == F.col("src"), "left").select(
        "source", "key", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.col("target_share") * size).alias("budget")
    )
    full = F.least(F.coalesce(F.floor(F.try_divide(F.col("budget"), F.col("available"))), F.lit(0)), F.col("max_repeats").cast("long"))
    out = out.withColumn("epochs", full)
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0)
    return out.withColumn("rest", rest)


def mix(docs: DataFrame, plan: DataFrame, seed: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(source, id, tokens, uses) of every document used at least once. ``docs`` from slim(), ``plan`` from budgets()."""
    rows = docs.join(small(plan.select("source", "key", "epochs", "rest")), F.col("src") == F.col("key"))
    u = _uniform(F.col("id"), seed)
    able = F.coalesce((F.col("weight") > 0) & ~F.isnan("weight"), F.lit(False))
    k = F.when(able, -F.log(u) / F.col("weight")).otherwise(1.0 - u)
    place = F.floor(F.log2(F.greatest(F.least("k", F.lit(1e300)), F.lit(1e-300))) * buckets)
    bucket = F.when(F.col("able"), place).otherwise(TAIL + F.floor(F.col("k") * (16 * buckets))).cast("int")
    rows = rows.withColumn("able", able).withColumn("k", k).withColumn("bucket", bucket)
    sums = rows.groupBy("key", "bucket").agg(F.sum("tokens").alias("w"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(F.col("key").alias("ok"), F.col("bucket").alias("ob"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("key", "bucket").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("tokens").over(inside) + F.col("offset")
    placed = rows.join(offs, (F.col("key") == F.col("ok")) & (F.col("bucket") == F.col("ob"))).withColumn("upto", upto)
    uses = F.col("epochs") + F.when((F.col("upto") <= F.col("rest")) & (F.col("tokens") > 0), 1).otherwise(0)
    return placed.select("source", "id", "tokens", uses.alias("uses")).where(F.col("uses") > 0)


def mix_report(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """The plan of every source beside the tokens and share it really has in the mix.

    ``short``: every document of the source is used as often as it may be, and
    the tokens still miss the budget.
    """
    used = mixed.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most_uses"))
    out = plan.join(used, F.col("source") == F.col("s"), "left").withColumn("used", F.coalesce("used", F.lit(0)))
    # the listed sources are few: one window over them all
    share = F.try_divide(F.col("used").cast("double"), F.sum("used").over(Window.partitionBy(F.lit(0))))
    short = (F.col("used") >= F.col("available") * F.col("max_repeats")) & (F.col("used") < F.col("budget"))
    return out.select("source", "target_share", "max_repeats", "available", "n_docs", "budget", "epochs", "used", "most_uses", share.alias("actual_share"), short.alias("short"))
