"""Queries of problem 1: exact per-taxon results on tables where few taxa hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.functions.codec import decode_kmer, pair_key
from merloom.operators import value_frequency as vf
from merloom.plans.common_sql import KEY
from merloom.session import table


def _pair_values(spark: SparkSession, d: str) -> DataFrame:
    return vf.value_frequencies(table(spark, d, "idx_pairs"), F.col("tax"), pair_key())


def _freq_values(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "freq").where(F.col("k") == 12)
    return vf.value_frequencies(f, F.col("tax"), F.col("n"), F.col("n"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = vf.key_totals(_pair_values(spark, d))
    n_pairs = table(spark, d, "idx_pairs").agg(F.count(F.lit(1))).scalar()
    counts = vf.key_totals(_freq_values(spark, d))
    n_counts = table(spark, d, "freq").where(F.col("k") == 12).agg(F.sum("n")).scalar()
    a = vf.heavy_keys(pairs, "rows", n_pairs, 2, 100).select(F.lit("idx_pairs").alias("table_name"), F.col("key").alias("tax"))
    b = vf.heavy_keys(counts, "total", n_counts, 2, 100).select(F.lit("freq").alias("table_name"), F.col("key").alias("tax"))
    return a.unionAll(b)


def p1_taxon_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct k-mers and the most frequent k-mer of every taxon."""
    v = _pair_values(spark, d)
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("freq")).alias("neg"), F.col("value").alias("value")))).alias("best")
    one = v.groupBy("key").agg(F.sum("rows").alias("n_rows"), F.count("value").alias("n_kmers"), best)
    return one.select(F.col("key").alias("tax"), "n_rows", "n_kmers", decode_kmer(F.col("best.value")).alias("mode_kmer"), (-F.col("best.neg")).alias("mode_rows"))


def p1_taxon_positions(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank quartiles and 99th percentile of the offsets of every taxon."""
    v = vf.value_frequencies(table(spark, d, "idx_pairs"), F.col("tax"), F.col("pos"))
    return vf.key_percentiles(v, [0.25, 0.5, 0.75, 0.99]).select(F.col("key").alias("tax"), "p", F.col("value").alias("pos"))


def p1_freq_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, sum of n, distinct n and the commonest n of every taxon at k = 12."""
    f = table(spark, d, "freq").where(F.col("k") == 12)
    v = vf.value_frequencies(f, F.col("tax"), F.col("n"))
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("freq")).alias("neg"), F.col("value").alias("value")))).alias("best")
    one = v.groupBy("key").agg(F.sum("rows").alias("n_rows"), F.sum(F.col("value") * F.col("freq")).alias("total_n"), F.count("value").alias("n_distinct"), best)
    return one.select(F.col("key").alias("tax"), "n_rows", "total_n", "n_distinct", F.col("best.value").alias("mode_n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_taxon_profile, p1_taxon_positions, p1_freq_totals)}

SQL = {
    "p1_found": """
        select 'idx_pairs' as table_name, tax from idx_pairs where tax is not null
        group by tax having count(*) * 100 >= 2 * (select count(*) from idx_pairs)
        union all
        select 'freq', tax from freq where k = 12 and tax is not null
        group by tax having sum(n) * 100 >= 2 * (select sum(n) from freq where k = 12)""",
    "p1_taxon_profile": f"""
        with p as (select tax, {KEY} as km from idx_pairs),
        c as (select tax, km, count(*) as n from p group by all),
        r as (select *, row_number() over (partition by tax order by n desc, km) as rn from c where km is not null)
        select t.tax, t.n_rows, t.n_kmers, r.km as mode_kmer, r.n as mode_rows
        from (select tax, sum(n)::bigint as n_rows, count(km) as n_kmers from c group by tax) t
        left join r on r.tax is not distinct from t.tax and r.rn = 1""",
    "p1_taxon_positions": """
        with o as (select tax, pos, row_number() over (partition by tax order by pos) as rn, count(*) over (partition by tax) as n
                   from idx_pairs where pos is not null)
        select tax, p, pos from o, (values (0.25::double), (0.5), (0.75), (0.99)) v(p) where rn = greatest(1, ceil(n * p))""",
    "p1_freq_totals": """
        with c as (select tax, n, count(*) as m from freq where k = 12 group by all),
        r as (select *, row_number() over (partition by tax order by m desc, n) as rn from c where n is not null)
        select t.*, r.n as mode_n from (select tax, sum(m)::bigint as n_rows, sum(n * m)::bigint as total_n, count(n) as n_distinct from c group by tax) t
        left join r on r.tax is not distinct from t.tax and r.rn = 1""",
}
