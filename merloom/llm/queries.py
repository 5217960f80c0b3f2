"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.functions.codec import decode_kmer, encode_kmer, pair_key
from merloom.llm import heavy, language, membership, mixing, packing, seen, splitting
from merloom.llm.sql import SQL
from merloom.llm.tokens import token_count
from merloom.session import materialise, small, table

__all__ = ["QUERIES", "SQL"]


def _answers(spark: SparkSession, d: str) -> DataFrame:
    pairs, base = table(spark, d, "idx_pairs"), table(spark, d, "base_idx")
    return seen.seen_before(pairs, F.col("pair_id"), pair_key(), base, encode_kmer(F.col("kmer")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("said_seen and seen").select(F.col("id").alias("pair_id"))


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_report(_answers(spark, d))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows whose key is seen and rows whose key is new, as the chain and its check give them, and whether the rate of wrong answers keeps its bound."""
    r = seen.error_report(_answers(spark, d))
    return r.select("n_rows", (F.col("n_said_seen") - F.col("n_wrong_seen")).alias("n_seen"), "n_new", (F.coalesce("wrong_rate", F.lit(0.0)) <= F.coalesce("error_bound", F.lit(0.0))).alias("within_bound"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    top = heavy.frequent_items(table(spark, d, "idx_pairs"), pair_key(), 5, 1000)
    return top.select(decode_kmer(F.col("key")).alias("kmer"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact rows of the frequent keys beside the summary's upper and lower count."""
    top = heavy.frequent_items(table(spark, d, "idx_pairs"), pair_key(), 5, 1000)
    return top.select(decode_kmer(F.col("key")).alias("kmer"), F.col("rows").alias("n_rows"), (F.col("count") >= F.col("rows")).alias("within_upper"), (F.col("count") - F.col("err") <= F.col("rows")).alias("within_lower"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    df = table(spark, d, "idx_pairs")
    return df, membership.cell_code(F.unix_date(F.to_date("added_at")), F.col("shard_id"))


def _cube(spark: SparkSession, d: str) -> DataFrame:
    df, cell = _cells(spark, d)
    rows = membership.rows_by_cube(df, cell, pair_key())
    km = membership.distinct_by_cube(membership.patterns(df, pair_key(), cell)).withColumnRenamed("n_distinct", "n_kmers")
    tx = membership.distinct_by_cube(membership.patterns(df, F.col("tax"), cell)).withColumnRenamed("n_distinct", "n_taxa")
    day, shard = membership.cell_day(F.col("grp")), membership.cell_shard(F.col("grp"))
    wide = rows.join(km, "grp", "left").join(tx, "grp", "left")
    return wide.select(
        F.when(day == membership.ALL, F.lit("all")).otherwise(F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")).alias("day"),
        shard.cast("int").alias("shard_id"), "n_rows", F.col("n_ident").alias("n_key_rows"),
        F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"), F.coalesce("n_taxa", F.lit(0)).alias("n_taxa"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    few = F.array(
        F.when(F.col("n_kmers") * 4 < F.col("n_key_rows"), F.lit("kmer")),
        F.when(F.col("n_taxa") < 5, F.lit("tax")),
    )
    return _cube(spark, d).select(F.explode(few).alias("measure"), "day", "shard_id").where(F.col("measure").isNotNull())


def p4_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d)


def p4_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of the first three shards together (any), of the rows that each of them has (all), and the same once the shards come as partial sets merged one by one."""
    df, cell = _cells(spark, d)
    parts = [membership.member_sets(df.where(F.col("shard_id") == i), pair_key(), cell) for i in (1, 2, 3)]
    pats = materialise(membership.patterns_of(membership.merge_sets(*parts)))
    of = lambda i: F.exists("pattern", lambda c: membership.cell_shard(c) == i)
    has = [of(i) for i in (1, 2, 3)]
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return pats.agg(n(has[0] | has[1] | has[2]).alias("n_any"), n(has[0] & has[1] & has[2]).alias("n_all"), n(has[0] & ~has[1]).alias("n_first_not_second"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    single = table(spark, d, "read_chunks").where(F.col("mate").isNull())
    return splitting.split_records(single).select("read_id", "cut")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized record, mates included, with its text."""
    chunks = table(spark, d, "read_chunks")
    return splitting.piece_texts(chunks, splitting.split_records(chunks))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized record: its letters, forced cuts, whether all pieces keep the limit, and a hash of its pieces joined without their overlaps."""
    chunks = table(spark, d, "read_chunks")
    s = splitting.split_records(chunks)
    text = splitting.piece_texts(chunks, s)
    over = F.when(F.col("piece_no") == 0, 0).when(F.col("kind") == "protein", splitting.OVERLAP["protein"]).otherwise(splitting.OVERLAP["dna"])
    parts = text.join(s.select("read_id", F.coalesce("mate", F.lit(-1)).alias("m"), "kind"), (F.coalesce(text["mate"], F.lit(-1)) == F.col("m")) & (text["read_id"] == s["read_id"]))
    parts = parts.select(text["read_id"], "m", "piece_no", F.length("text").alias("size"), F.substring("text", over + 1, F.length("text")).alias("t"))
    whole = parts.groupBy("read_id", "m").agg(F.array_sort(F.collect_list(F.struct("piece_no", "t"))).alias("ts"), F.max("size").alias("most"))
    whole = whole.select("read_id", "m", F.md5(F.array_join(F.transform("ts", lambda x: x["t"]), "")).alias("joined"), (F.col("most") <= splitting.LIMIT).alias("within"))
    got = s.select("read_id", F.coalesce("mate", F.lit(-1)).alias("m"), "n_letters", F.col("n_forced").cast("long").alias("n_forced"))
    return got.join(whole, ["read_id", "m"]).withColumnRenamed("m", "mate")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(docs, F.col("doc_id"), token_count(F.col("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("oversized").select(F.col("id").alias("doc_id")).distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p6_fill_by_letters(spark: SparkSession, d: str) -> DataFrame:
    """The same packing with sizes in characters, which SQL can count: items, their total, the least containers for it, and what must not occur.

    ``n_over`` containers hold more than their capacity, ``n_torn`` documents within the
    capacity lie in more than one, ``n_wrong`` documents lack a part of their size;
    ``full`` says that at most 1 % more containers (and one) are used than the least.
    """
    docs = table(spark, d, "documents")
    room = 4 * packing.CAPACITY
    got = materialise(packing.pack(docs, F.col("doc_id"), F.length("text").cast("long"), room))
    per = got.groupBy("id").agg(F.max("n_tokens").alias("n"), F.sum("size").alias("s"), F.countDistinct("container").alias("boxes"))
    bad = per.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("n") <= room) & (F.col("boxes") > 1)).alias("n_torn"), F.count_if(F.col("n") != F.col("s")).alias("n_wrong"))
    box = got.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("size").alias("used"))
    fill = box.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_letters"), F.count_if(F.col("used") > room).alias("n_over"))
    least = F.ceil(F.col("n_letters") / F.lit(room))
    one = F.lit(1).alias("one")
    return bad.select("*", one).join(fill.select("*", one), "one").select("n_docs", "n_letters", least.alias("least_containers"), "n_over", "n_torn", "n_wrong", (F.col("c") <= least * 1.01 + 1).alias("full"))


def _mix_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("chars"), token_count(F.col("text")).alias("n_tokens"))
    return mixing.slim(docs, F.col("doc_id"), F.col("source"), F.col("n_tokens"), mixing.quality_weight(F.col("chars"), F.col("n_tokens")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _mix_docs(spark, d)
    plan = mixing.budgets(docs, table(spark, d, "source_targets"))
    return mixing.mix_report(plan, mixing.mix(docs, plan)).where("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = _mix_docs(spark, d)
    plan = mixing.budgets(docs, table(spark, d, "source_targets"))
    return mixing.mix(docs, plan).withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    docs = _mix_docs(spark, d)
    plan = mixing.budgets(docs, table(spark, d, "source_targets"))
    return mixing.mix_report(plan, mixing.mix(docs, plan))


def p7_report_by_letters(spark: SparkSession, d: str) -> DataFrame:
    """The same mix with sizes in characters, which SQL can count: the plan of each source, and whether what it uses misses its budget by less than its longest document."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    slim = mixing.slim(docs, F.col("doc_id"), F.col("source"), F.coalesce("n", F.lit(0)), F.lit(1.0))
    plan = mixing.budgets(slim, table(spark, d, "source_targets"))
    longest = slim.groupBy("src").agg(F.max("tokens").alias("longest"))
    r = mixing.mix_report(plan, mixing.mix(slim, plan)).join(longest, mixing.source_name(F.col("source")) == F.col("src"), "left")
    used = F.when(F.col("short"), F.col("used") == F.col("available") * F.col("max_repeats")).otherwise((F.col("used") <= F.col("budget")) & (F.col("used") > F.col("budget") - F.col("longest")))
    return r.select("source", "available", "n_docs", F.round("budget", 3).alias("budget"), "epochs", "short", used.alias("used_well"))


def _net(spark: SparkSession, d: str):
    return language.fit(table(spark, d, "lang_samples"), table(spark, d, "documents"), table(spark, d, "lang_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    said = language.languages(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), _net(spark, d), F.col("lang"), segments=False)
    known = table(spark, d, "lang_labels").where("code is not null").groupBy(F.col("label").alias("name")).agg(F.min("code").alias("code"))
    named = said.join(small(known), F.col("label") == F.col("name"), "left")
    wrong = F.col("code").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("code"))
    return named.where(wrong).select(F.col("id").alias("doc_id"), F.explode("langs").alias("lang"))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    said = language.languages(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), _net(spark, d), segments=False)
    return said.select(F.col("id").alias("doc_id"), "langs", "confidence")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every run of sentences in one language, with its confidence."""
    said = language.languages(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), _net(spark, d))
    return said.select(F.col("id").alias("doc_id"), F.explode("segments").alias("s")).select("doc_id", "s.*")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_error_rate, p2_totals, p3_found, p3_counts, p4_found, p4_distinct_counts, p4_combinations, p5_found, p5_pieces, p5_records, p6_found, p6_containers, p6_fill, p6_fill_by_letters, p7_found, p7_mix, p7_report, p7_report_by_letters, p8_found, p8_documents, p8_segments)
}
