"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.functions.codec import clean_dna
from merloom.operators import identify, windows
from merloom.plans import common_sql as q
from merloom.plans import identification as ident
from merloom.session import materialise
from merloom.streaming import pipelines


def stream_assemble_reads(spark: SparkSession, d: str) -> DataFrame:
    """P12, S7 as a stream: chunks held in state until their record is whole."""
    s = pipelines.assemble_stream(pipelines.read_stream(spark, f"{d}/read_chunks.parquet"))
    return pipelines.run_available(s, stateful=True).select("read_id", "mate", "kind", "seq", "n_chunks")


def stream_profile(spark: SparkSession, d: str) -> DataFrame:
    """A1-A3 kept up by batches: taxon counts of all records.

    Records are put together in state, so a copy of a chunk counts once
    whatever batch brings it; counts of codes are added up over the batches.
    """
    idx = ident._idx(spark, d)

    def partial(df: DataFrame) -> DataFrame:
        w = windows.kmer_windows(df.where("coalesce(kind, 'dna') = 'dna'"), clean_dna(F.col("seq")), ["read_id", "mate"], min_k=ident.MIN_K)
        return identify.occurrences(w, idx, [], ident.MIN_K)

    whole = pipelines.assemble_stream(pipelines.read_stream(spark, f"{d}/read_chunks.parquet"))
    codes = materialise(pipelines.run_batches(whole, partial).groupBy("code").agg(F.sum("n").alias("n")))
    matched = identify.match_counted(codes, idx, [], ident.MIN_K, ident.MAX_K)
    return identify.count_taxa(matched).withColumn("count_all", F.round("count_all", 6))


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling event-time windows behind a watermark; open windows are not given yet."""
    s = pipelines.event_windows(pipelines.read_stream(spark, f"{d}/events.parquet"))
    return pipelines.run_available(s).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows of each user."""
    s = pipelines.sessions(pipelines.read_stream(spark, f"{d}/events.parquet"))
    x = pipelines.run_available(s)
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"))


QUERIES = {f.__name__: f for f in (stream_assemble_reads, stream_profile, stream_event_windows, stream_sessions)}

SQL = {
    "stream_assemble_reads": f"with {q.READS}, n as (select read_id, mate, count(*)::int as n_chunks from ch group by all) select rd.read_id, rd.mate, kind, seq, n_chunks from rd join n on rd.read_id = n.read_id and rd.mate is not distinct from n.mate",
    "stream_profile": ident.SQL["profile_counts"],
    "stream_event_windows": """with w as (select date_trunc('day', ts) as s, event_type, count(*) as n, sum(value) as total from events group by all)
        select strftime(s, '%Y-%m-%d') as day, event_type, n, round(total, 2) as total from w where s + interval 1 day <= (select max(ts) from events) - interval 1 hour""",
    "stream_sessions": """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as b from events),
        g as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as s from e),
        x as (select user_id, s, count(*) as n, max(ts) + interval 30 minute as e from g group by user_id, s)
        select user_id, count(*) as n_sessions, sum(n)::bigint as n_events from x where e <= (select max(ts) from events) - interval 1 hour group by user_id""",
}
