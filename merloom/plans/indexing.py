"""Queries over the (k-mer, taxon) index: build, maintenance, statistics, shrinking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.functions.codec import clean_dna, decode_kmer, encode_kmer, pair_key
from merloom.operators import content, index, reads, windows
from merloom.plans import common_sql as q
from merloom.plans import taxonomy as tx
from merloom.session import table


def _idx(spark: SparkSession, d: str) -> DataFrame:
    return index.build(table(spark, d, "idx_pairs"), pair_key(), F.col("tax"))


def _base(spark: SparkSession, d: str) -> DataFrame:
    return index.build(table(spark, d, "base_idx"), encode_kmer(F.col("kmer")), F.col("tax"))


def _text(df: DataFrame, *more: str) -> DataFrame:
    return df.select(decode_kmer(F.col("code")).alias("kmer"), *more)


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """U8, O2, O3: distinct index rows of all pairs."""
    return _text(_idx(spark, d), "tax")


def index_from_references(spark: SparkSession, d: str) -> DataFrame:
    """Index rows per taxon built from the records with a known accession."""
    return _reference_index(reads.with_tax(reads.assemble(table(spark, d, "read_chunks")), table(spark, d, "acc_map")))


def index_from_references_headers(spark: SparkSession, d: str) -> DataFrame:
    """The same from all records that have a header, dummies included."""
    return _reference_index(reads.with_content(reads.assemble(table(spark, d, "read_chunks")), tx._generated(spark, d, "lowest", True)))


def _reference_index(refs: DataFrame) -> DataFrame:
    ref = refs.where("kind = 'dna'")
    w = windows.drop_unknown(windows.kmer_windows(ref, clean_dna(F.col("seq")), ["tax"], side="reference"))
    return index.build(w, F.col("code"), F.col("tax")).groupBy("tax").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.pmod("code", F.lit(1000003))).alias("checksum"))


def index_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each taxon for every k."""
    return index.frequencies(_idx(spark, d))


def index_directory(spark: SparkSession, d: str) -> DataFrame:
    """Start and size of every six-letter prefix."""
    out = index.directory(_idx(spark, d))
    return out.select(decode_kmer(F.shiftleft("prefix", 30)).substr(1, 6).alias("prefix"), "start", "cnt")


def index_update(spark: SparkSession, d: str) -> DataFrame:
    """The stored index with all new pairs."""
    return _text(index.update(_base(spark, d), _idx(spark, d)), "tax")


def index_merge_renamed(spark: SparkSession, d: str) -> DataFrame:
    """Union of two indices whose content tables are merged: the dummies of the second are renamed as that merge says."""
    own = content.parse(table(spark, d, "content_file"))
    renamed = content.merge(tx._generated(spark, d, "species"), own)[1].where("side = 2").select("old", "new")
    return _text(index.merge(_base(spark, d), _idx(spark, d), None, renamed), "tax")


def index_delete(spark: SparkSession, d: str) -> DataFrame:
    """Without taxa that the taxonomy does not know."""
    idx, nodes = _idx(spark, d), table(spark, d, "tax_nodes").select("tax").distinct()
    gone = idx.select("tax").distinct().join(nodes, "tax", "left_anti")
    return _text(index.delete(idx, gone), "tax")


def index_taxa_per_kmer(spark: SparkSession, d: str) -> DataFrame:
    """Distinct taxa of every k-mer."""
    return _text(index.taxa_per_kmer(_idx(spark, d)), "n_taxa")


def redundancy_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    return index.redundancy(_idx(spark, d)).select("n_taxa", "n_kmers", F.round("share", 8).alias("share"), F.round("cumulative", 8).alias("cumulative"))


def redundancy_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """A10, W6."""
    return index.redundancy_cutoff(_idx(spark, d))


def shrink_every_nth(spark: SparkSession, d: str) -> DataFrame:
    """Half of the rows of each taxon."""
    return _text(index.shrink_every_nth(_idx(spark, d), 50.0), "tax")


def shrink_entropy(spark: SparkSession, d: str) -> DataFrame:
    """H3, F11."""
    return _text(index.shrink_entropy(_idx(spark, d)), "tax")


def shrink_halve(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct suffixes of every prefix of the halved index."""
    h = index.shrink_halve(_idx(spark, d))
    return h.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("suffix").alias("n_suffixes"), F.sum("suffix").alias("checksum"))


def shrink_overrepresented(spark: SparkSession, d: str) -> DataFrame:
    """H4."""
    return _text(index.shrink_overrepresented(_idx(spark, d), 2), "tax")


def frequent_kmers(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return index.frequent_kmers(_idx(spark, d)).select(decode_kmer(F.col("code")).alias("kmer"), "n_taxa", F.array_join(F.col("taxa").cast("array<string>"), ";").alias("taxa"))


def csr_transform(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return index.csr(_idx(spark, d)).select(decode_kmer(F.col("code")).alias("kmer"), "start", F.array_join(F.col("taxa").cast("array<string>"), ";").alias("taxa"))


def kmer_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of the k-mers stored before."""
    return _text(index.lookup(_idx(spark, d), _base(spark, d)), "tax")


def repack_odd_letters(spark: SparkSession, d: str) -> DataFrame:
    """Legacy layout: letters 1, 3, 5, ... of each k-mer."""
    return index.repack_odd_letters(_idx(spark, d))


def hash_letter_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of letters hashed to one."""
    return index.hash_pairs(_idx(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        index_build, index_from_references, index_from_references_headers, index_frequencies, index_directory, index_update, index_merge_renamed, index_delete, index_taxa_per_kmer, redundancy_histogram, redundancy_cutoff,
        shrink_every_nth, shrink_entropy, shrink_halve, shrink_overrepresented, frequent_kmers, csr_transform, kmer_lookup, repack_odd_letters, hash_letter_pairs,
    )
}

_I = f"with {q.IDX}"
_BASE = "base as (select distinct kmer, tax from base_idx where kmer is not null and tax is not null)"
_DNA_REF = f"select r.tax as read_id, row_number() over () as mate, {q.clean('r.seq')} as s, repeat('X', 33) as pad from ref r where kind = 'dna' and length(seq) > 0"
_CODE12 = " + ".join(f"((ascii(substr(kmer, {i + 1}, 1)) & 31)::bigint << {5 * (11 - i)})" for i in range(12))
_LOW6 = " + ".join(f"((ascii(substr(kmer, {i + 7}, 1)) & 31)::bigint << {5 * (5 - i)})" for i in range(6))
_HIGH6 = " + ".join(f"((ascii(substr(kmer, {i + 1}, 1)) & 31)::bigint << {5 * (5 - i)})" for i in range(6))
_ODD6 = " + ".join(f"((ascii(substr(kmer, {2 * i + 1}, 1)) & 31)::bigint << {5 * (5 - i)})" for i in range(6))
_HASH = " + ".join(f"((((ascii(substr(kmer, {2 * i + 1}, 1)) & 31) * 5 + (ascii(substr(kmer, {2 * i + 2}, 1)) & 31) * 3) % 26 + 1)::bigint << {5 * (5 - i)})" for i in range(6))

SQL = {
    "index_build": f"{_I} select * from idx",
    "index_from_references": f"""with {q.READS}, a as (select accession, min(tax) as tax from acc_map where tax is not null group by accession),
        ref as (select r.*, a.tax from (select *, {q.accession('name')} as acc from rd) r join a on r.acc = a.accession),
        {q.windows_cte(_DNA_REF, [(0, "s")], "len(ls) - 33", 3, 1, where=q.NO_UNKNOWN)},
        i as (select distinct read_id as tax, code from win)
        select tax, count(*) as n_rows, sum(code % 1000003)::bigint as checksum from i group by tax""",
    "index_frequencies": f"{_I}, k as (select unnest(range(1, 13))::int as k) select tax, k, count(*) filter (substr(kmer, k, 1) <> '^') as n from idx, k group by tax, k",
    "index_directory": f"{_I}, p as (select substr(kmer, 1, 6) as prefix, count(*) as cnt from idx group by 1) select prefix, coalesce(sum(cnt) over (order by encode(prefix) rows between unbounded preceding and 1 preceding), 0)::bigint as start, cnt from p",
    "index_update": f"{_I}, {_BASE} select * from idx union select * from base",
    "index_merge_renamed": f"""with recursive {tx._generate('species')}, {tx._CONTENT}, bt as (select 1 as side, name, tax from gen union all select 2, name, tax from cf), {tx._DUM},
        rn as (select tax as old, 4294967295 - i as new from dm where side = 2), {q.IDX}, {_BASE} select kmer, coalesce(new, tax) as tax from idx left join rn on old = tax union select * from base""",
    "index_delete": f"{_I} select * from idx where tax in (select tax from tax_nodes)",
    "index_taxa_per_kmer": f"{_I} select kmer, count(*) as n_taxa from idx group by kmer",
    "redundancy_histogram": f"""{_I}, n as (select kmer, count(*) as n_taxa from idx group by kmer), h as (select n_taxa, count(*) as n_kmers from n group by n_taxa)
        select n_taxa, n_kmers, round(n_taxa * n_kmers / (sum(n_taxa * n_kmers) over ())::double, 8) as share, round(sum(n_taxa * n_kmers) over (order by n_taxa) / (sum(n_taxa * n_kmers) over ())::double, 8) as cumulative from h""",
    "redundancy_cutoff": f"""{_I}, n as (select kmer, count(*) as n_taxa from idx group by kmer), h as (select n_taxa, count(*) as n_kmers from n group by n_taxa),
        c as (select n_taxa, sum(n_taxa * n_kmers) over (order by n_taxa) / (sum(n_taxa * n_kmers) over ())::double as c from h)
        select min(n_taxa) as cutoff, case when min(n_taxa) = 1 then 'unique' when min(n_taxa) < 4 then 'low' else 'high' end as verdict from c where c >= 0.99""",
    "shrink_every_nth": f"{_I}, r as (select *, row_number() over (partition by tax order by encode(kmer)) as rn from idx) select kmer, tax from r where rn % 2 <> 0",
    "shrink_entropy": f"""{_I}, u as (select distinct kmer from idx), l as (select kmer, unnest(string_split(kmer, '')) as c from u), n as (select kmer, c, count(*) / 12.0 as p from l where c <> '' group by all),
        e as (select kmer from n group by kmer having -sum(p * log2(p)) * ln(2) / ln(22) > 0.5) select idx.* from idx semi join e using (kmer)""",
    "shrink_halve": f"{_I} select {_HIGH6} as prefix, count(*) as n_rows, count(distinct substr(kmer, 7)) as n_suffixes, sum({_LOW6})::bigint as checksum from idx where substr(kmer, 7) <> '^^^^^^' group by 1",
    "shrink_overrepresented": f"{_I} select * from idx where kmer in (select kmer from idx group by kmer having count(*) <= 2)",
    "frequent_kmers": f"{_I} select kmer, count(*) as n_taxa, string_agg(tax::varchar, ';' order by tax) as taxa from idx group by kmer having count(*) >= 4",
    "csr_transform": f"{_I}, g as (select kmer, count(*) as n, string_agg(tax::varchar, ';' order by tax) as taxa from idx group by kmer) select kmer, coalesce(sum(n) over (order by encode(kmer) rows between unbounded preceding and 1 preceding), 0)::bigint as start, taxa from g",
    "kmer_lookup": f"{_I} select * from idx where kmer in (select kmer from base_idx)",
    "repack_odd_letters": f"{_I} select distinct {_ODD6} as code, tax from idx",
    "hash_letter_pairs": f"{_I} select distinct {_HASH} as code, tax from idx",
}

_DUMMIES = """a as (with mp as (select accession, min(tax) as tax from acc_map where tax is not null group by accession),
        hd as (select distinct coalesce(ACC, trim(name, chr(32) || chr(9) || chr(10) || chr(13))) as accession from read_chunks where trim(name, chr(32) || chr(9) || chr(10) || chr(13)) <> '')
        select accession, case when tax is null then 4294967295 - row_number() over (partition by tax is null order by accession) else tax end as tax from hd left join mp using (accession))""".replace("ACC", q.accession("name"))
SQL["index_from_references_headers"] = f"""with {q.READS}, {_DUMMIES},
        ref as (select r.*, a.tax from (select *, coalesce({q.accession('name')}, name) as acc from rd) r join a on r.acc = a.accession),
        {q.windows_cte(_DNA_REF, [(0, "s")], "len(ls) - 33", 3, 1, where=q.NO_UNKNOWN)},
        i as (select distinct read_id as tax, code from win)
        select tax, count(*) as n_rows, sum(code % 1000003)::bigint as checksum from i group by tax"""
SQL["reference_sequences_headers"] = f"""with {q.READS}, {_DUMMIES}
        select read_id, mate, accession, tax, kind, length(seq) as seq_len from (select *, coalesce({q.accession('name')}, name) as acc from rd) r join a on r.acc = a.accession"""
