"""Queries of the ordered-data operators (X1-X30) on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.operators import sequence_store as s
from merloom.session import table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


def sort_with_rank(spark: SparkSession, d: str) -> DataFrame:
    """Orders by price, ties by key."""
    return s.ranked(_orders(spark, d), F.desc("o_totalprice"), F.col("o_orderkey")).select("rank", "o_orderkey", "o_totalprice")


def sort_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Line items by part, in their first order within a part."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").distinct()
    return s.ranked(li, F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_extendedprice")).select("rank", "l_partkey", "l_orderkey", "l_linenumber")


def sorted_check(spark: SparkSession, d: str) -> DataFrame:
    """Along the orders sorted by price, which columns are in order."""
    r = s.ranked(_orders(spark, d), F.col("o_totalprice"), F.col("o_orderkey"))
    checks = [s.is_sorted(r, c).select(F.lit(c).alias("name"), "sorted") for c in ("o_totalprice", "o_orderkey", "o_custkey", "rank")]
    return checks[0].unionByName(checks[1]).unionByName(checks[2]).unionByName(checks[3])


def for_each_row(spark: SparkSession, d: str) -> DataFrame:
    """One function over all rows."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


def generate_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Squares of positions."""
    return s.generate(spark, 1000, F.col("id") * F.col("id"))


def find_first(spark: SparkSession, d: str) -> DataFrame:
    """The first order, by key, over 400,000."""
    return s.find_first(_orders(spark, d), F.col("o_totalprice") > 400000, "o_orderkey").select("o_orderkey", "o_totalprice")


def random_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The orders in a seeded random order."""
    return s.shuffled(_orders(spark, d), F.col("o_orderkey"), 7).select("rank", "o_orderkey")


def zip_transform(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers side by side by balance, and the difference."""
    c = s.ranked(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), F.col("c_custkey"))
    p = s.ranked(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.desc("s_acctbal"), F.col("s_suppkey"))
    return s.zipped(c, p).select("rank", "c_custkey", "s_suppkey", F.round(F.col("c_acctbal") - F.col("s_acctbal"), 4).alias("diff"))


def unique_consecutive(spark: SparkSession, d: str) -> DataFrame:
    """Changes of priority along the order keys."""
    r = s.ranked(_orders(spark, d), F.col("o_orderkey"))
    return s.unique_consecutive(r, "o_orderpriority").select("rank", "o_orderkey", "o_orderpriority")


def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a range of keys."""
    return s.between(_orders(spark, d), "o_orderkey", F.lit(100), F.lit(300)).select("o_orderkey", "o_custkey")


def hash_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sort and sum, spending of every customer."""
    return s.sums(_orders(spark, d), "o_custkey", F.col("o_totalprice").cast("decimal(18,2)"))


def priority_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 largest line items."""
    o = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return s.top(table(spark, d, "lineitem"), 100, *o).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def queue_ends(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of a queue of orders by date."""
    r = s.ranked(_orders(spark, d), F.col("o_orderdate"), F.col("o_orderkey"))
    front = s.top(r, 5, F.col("rank")).select(F.lit("front").alias("place"), "rank", "o_orderkey")
    back = s.top(r, 5, F.desc("rank")).select(F.lit("back").alias("place"), "rank", "o_orderkey")
    return front.unionByName(back)


def stack_replay(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a log (purchases and errors pop, all else push); what is left."""
    e = table(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("rank"), F.when(F.col("event_type").isin("purchase", "error"), "pop").otherwise("push").alias("op"))
    return s.stack_replay(e).select("log", "rank")


def matrix_gram(spark: SparkSession, d: str) -> DataFrame:
    """Transpose times matrix of the embeddings."""
    g = s.gram(s.matrix_of(table(spark, d, "embeddings"), "vec_id", "embedding"))
    return g.select("i", "j", F.round("v", 4).alias("v"))


def matrix_sum(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of the embeddings plus its transpose."""
    e = s.matrix_of(table(spark, d, "embeddings"), "vec_id", "embedding")
    return s.matrix_add(e, s.matrix_transpose(e)).select("i", "j", F.round("v", 6).alias("v"))


def suffix_array(spark: SparkSession, d: str) -> DataFrame:
    """Suffixes of the names of all suppliers, joined in the order of their keys (long repeats)."""
    o = table(spark, d, "supplier").select("s_suppkey", "s_name")
    name = o.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]), "|").alias("t"))
    chars = name.select(F.posexplode(F.split("t", "")).alias("pos", "c")).where("c <> ''")
    return s.suffix_array(chars).select(F.col("pos").cast("long").alias("pos"), "place")


QUERIES = {
    f.__name__: f
    for f in (
        sort_with_rank, sort_by_key, sorted_check, for_each_row, generate_sequence, find_first, random_shuffle, zip_transform, unique_consecutive, range_lookup, hash_sums, priority_top, queue_ends, stack_replay, matrix_gram,
        matrix_sum, suffix_array,
    )
}

SQL = {
    "sort_with_rank": "select row_number() over (order by o_totalprice desc, o_orderkey) as rank, o_orderkey, o_totalprice from orders",
    "sort_by_key": "select row_number() over (order by l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as rank, l_partkey, l_orderkey, l_linenumber from (select distinct l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice from lineitem)",
    "sorted_check": """with r as (select *, row_number() over (order by o_totalprice, o_orderkey) as rank from orders),
        l as (select *, lag(o_totalprice) over w as p, lag(o_orderkey) over w as k, lag(o_custkey) over w as c from r window w as (order by rank))
        select 'o_totalprice' as name, count(*) filter (o_totalprice < p) = 0 as sorted from l union all select 'o_orderkey', count(*) filter (o_orderkey < k) = 0 from l
        union all select 'o_custkey', count(*) filter (o_custkey < c) = 0 from l union all select 'rank', count(distinct rank) = max(rank) from r""",
    "for_each_row": "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem",
    "generate_sequence": "select i + 1 as rank, i * i as value from range(1000) r(i)",
    "find_first": "select o_orderkey, o_totalprice from orders where o_totalprice > 400000 order by o_orderkey limit 1",
    "random_shuffle": "select row_number() over (order by md5('7:' || o_orderkey), o_orderkey) as rank, o_orderkey from orders",
    "zip_transform": """with c as (select c_custkey, c_acctbal, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer), s as (select s_suppkey, s_acctbal, row_number() over (order by s_acctbal desc, s_suppkey) as rank from supplier)
        select rank, c_custkey, s_suppkey, round(c_acctbal - s_acctbal, 4) as diff from c join s using (rank)""",
    "unique_consecutive": "with r as (select row_number() over (order by o_orderkey) as rank, o_orderkey, o_orderpriority, lag(o_orderpriority) over (order by o_orderkey) as p from orders) select rank, o_orderkey, o_orderpriority from r where rank = 1 or p is distinct from o_orderpriority",
    "range_lookup": "select o_orderkey, o_custkey from orders where o_orderkey >= 100 and o_orderkey < 300",
    "hash_sums": "select o_custkey, sum(o_totalprice::decimal(18,2)) as total from orders group by o_custkey",
    "priority_top": "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 100",
    "queue_ends": """with r as (select row_number() over (order by o_orderdate, o_orderkey) as rank, o_orderkey from orders)
        select 'front' as place, * from r where rank <= 5 union all select 'back', * from r where rank > (select count(*) from orders) - 5""",
    "stack_replay": """with e as (select user_id as log, event_id as rank, case when event_type in ('purchase', 'error') then -1 else 1 end as s from events),
        x as (select *, sum(s) over (partition by log order by rank) as depth from e),
        y as (select *, min(depth) over (partition by log order by rank rows between 1 following and unbounded following) as low from x)
        select log, rank from y where s = 1 and (low is null or low >= depth)""",
    "matrix_gram": "with m as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as j from embeddings) select a.j as i, b.j as j, round(sum(a.v * b.v), 4) as v from m a join m b using (vec_id) group by a.j, b.j",
    "matrix_sum": "with m as (select vec_id::bigint as i, unnest(embedding)::double as v, (generate_subscripts(embedding, 1) - 1)::bigint as j from embeddings), b as (select i, j, v from m union all select j, i, v from m) select i, j, round(sum(v), 6) as v from b group by i, j",
    "suffix_array": "with t as (select string_agg(s_name, '|' order by s_suppkey) as t from supplier), p as (select unnest(range(0, length(t))) as pos, t from t) select pos, row_number() over (order by substr(t, (pos + 1)::int)) as place from p",
}
