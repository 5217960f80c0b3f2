"""Abundance profiles from taxon counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merloom.operators import sequence_store


def input_size(n_windows: DataFrame, n_reads: DataFrame, min_k: int, max_k: int, frames: int = 3) -> DataFrame:
    """(k, total): windows of the input less the padded ones, for each k. Both inputs are one-row tables."""
    ks = F.explode(F.array(*[F.lit(k) for k in range(min_k, max_k + 1)])).alias("k")
    one = n_windows.select(F.lit(1).alias("j"), F.col("n").alias("w")).join(n_reads.select(F.lit(1).alias("j"), F.col("n").alias("r")), "j")
    return one.select("w", "r", ks).select("k", (F.col("w") - F.col("r") * frames * (F.col("k") - min_k)).alias("total"))


def relative(counts: DataFrame, total: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Counts with their shares among identified and among all windows; ``freq`` (tax, k, n) adds the coverage."""
    k = Window.partitionBy("k")
    x = counts.join(F.broadcast(total), "k")  # one row for each k
    x = x.withColumn("unique_rel", F.coalesce(F.try_divide(F.col("count_unique").cast("double"), F.sum("count_unique").over(k)), F.lit(0.0)))
    x = x.withColumn("all_rel", F.try_divide(F.col("count_all"), F.sum("count_all").over(k)))
    x = x.withColumn("overall_rel", F.try_divide(F.col("count_all"), F.col("total"))).withColumn("overall_unique_rel", F.try_divide(F.col("count_unique").cast("double"), F.col("total")))
    if freq is not None:
        x = x.join(freq, ["tax", "k"], "left").withColumn("coverage", F.try_divide(F.col("count_total").cast("double"), F.col("n"))).drop("n")
    return x.drop("total")


def not_identified(rel: DataFrame, total: DataFrame) -> DataFrame:
    """(k, overall_rel): what no taxon accounts for; 1 where nothing matched."""
    got = rel.groupBy("k").agg(F.sum("overall_rel").alias("s"))
    return total.join(got, "k", "left").select("k", (1.0 - F.coalesce("s", F.lit(0.0))).alias("overall_rel"))


def wide(rel: DataFrame, min_k: int, max_k: int, digits: int = 6, coverage: bool = False) -> DataFrame:
    """One row for each taxon with the counts of every k side by side, for taxa with a count at min_k; ``coverage`` adds matched prefixes and their share."""
    cols = []
    names = ("count_unique", "unique_rel", "count_all", "all_rel", "overall_rel", "overall_unique_rel", *(("count_total", "coverage") if coverage else ()))
    for k in range(max_k, min_k - 1, -1):
        for c in names:
            v = F.coalesce(F.sum(F.when(F.col("k") == k, F.col(c))), F.lit(0))
            cols.append((F.round(v, digits) if c not in ("count_unique", "count_total") else v).alias(f"{c}_{k}"))
    out = rel.groupBy("tax").agg(*cols)
    return out.where(F.col(f"count_all_{min_k}") > 0)


def ranked(wide_rows: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """Profile rows numbered by their unique counts from the largest k on; ties by taxon."""
    order = [F.desc(f"count_unique_{k}") for k in range(max_k, min_k - 1, -1)]
    return sequence_store.ranked(wide_rows, *order, F.col("tax"))
