"""Queries of the content table and the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.functions.text import accession_of, comma_to_blank, split_list
from merloom.operators import content, reads, reports
from merloom.plans import common_sql as q
from merloom.session import table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return reports.clean_nodes(table(spark, d, "tax_nodes"))


def _accessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "read_chunks").select(accession_of(F.col("name")).alias("accession")).where("accession is not null").distinct()


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """Every header's accession, or the whole header where it has none."""
    return table(spark, d, "read_chunks").select(reads.whole_header(F.col("name")).alias("accession")).where("accession is not null").distinct()


def _generated(spark: SparkSession, d: str, level: str, headers: bool = False) -> DataFrame:
    return content.generate((_headers if headers else _accessions)(spark, d), table(spark, d, "acc_map"), _nodes(spark, d), table(spark, d, "tax_names"), level)


def taxonomy_names(spark: SparkSession, d: str) -> DataFrame:
    """Scientific names, with commas as blanks (P20)."""
    n = content.scientific_names(table(spark, d, "tax_names"))
    return n.select("tax", comma_to_blank(F.col("name")).alias("name"))


def taxonomy_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node with all nodes above it."""
    n = _nodes(spark, d)
    return reports.ancestors(n, n)


def taxonomy_lift(spark: SparkSession, d: str) -> DataFrame:
    """Every taxon of the accession map lifted to its genus."""
    return reports.lift(_nodes(spark, d), table(spark, d, "acc_map"), "genus")


def accession_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Taxon of every accession in the headers."""
    return content.accession_taxa(_accessions(spark, d), table(spark, d, "acc_map"))


def content_generate_species(spark: SparkSession, d: str) -> DataFrame:
    """Content table at the level of species."""
    return content.joined(_generated(spark, d, "species"))


def content_generate_genus(spark: SparkSession, d: str) -> DataFrame:
    """U9 at the level of genus."""
    return content.joined(_generated(spark, d, "genus"))


def content_generate_lowest(spark: SparkSession, d: str) -> DataFrame:
    """Every taxon by itself."""
    return content.joined(_generated(spark, d, "lowest"))


def content_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Q21: accessions numbered in their order, without a taxonomy."""
    return content.generate_lowest_numbered(_accessions(spark, d))


def content_merge(spark: SparkSession, d: str) -> DataFrame:
    """The stored content table with the generated one."""
    return content.joined(content.merge(content.parse(table(spark, d, "content_file")), _generated(spark, d, "species"))[0])


def content_dummies_renamed(spark: SparkSession, d: str) -> DataFrame:
    """New ids of the dummies of both sides."""
    return content.merge(content.parse(table(spark, d, "content_file")), _generated(spark, d, "species"))[1]


def content_repair(spark: SparkSession, d: str) -> DataFrame:
    """One row for each taxon from two overlapping tables."""
    both = content.parse(table(spark, d, "content_file")).unionByName(_generated(spark, d, "lowest"))
    return content.joined(content.repair(both))


def content_generate_species_headers(spark: SparkSession, d: str) -> DataFrame:
    """Content table of all headers, those without an accession as dummies."""
    return content.joined(_generated(spark, d, "species", True))


def content_generate_genus_headers(spark: SparkSession, d: str) -> DataFrame:
    """U9, J7 at the level of genus."""
    return content.joined(_generated(spark, d, "genus", True))


def content_generate_lowest_headers(spark: SparkSession, d: str) -> DataFrame:
    """Every taxon by itself."""
    return content.joined(_generated(spark, d, "lowest", True))


def content_numbered_headers(spark: SparkSession, d: str) -> DataFrame:
    """Q21: all headers numbered in their order."""
    return content.generate_lowest_numbered(_headers(spark, d))


def content_merge_headers(spark: SparkSession, d: str) -> DataFrame:
    """U5, U6, A11 with all headers."""
    return content.joined(content.merge(content.parse(table(spark, d, "content_file")), _generated(spark, d, "species", True))[0])


def content_dummies_renamed_headers(spark: SparkSession, d: str) -> DataFrame:
    """U5 with all headers."""
    return content.merge(content.parse(table(spark, d, "content_file")), _generated(spark, d, "species", True))[1]


def content_repair_headers(spark: SparkSession, d: str) -> DataFrame:
    """U7 with all headers."""
    both = content.parse(table(spark, d, "content_file")).unionByName(_generated(spark, d, "lowest", True))
    return content.joined(content.repair(both))


def content_accessions(spark: SparkSession, d: str) -> DataFrame:
    """Accessions of the content file as rows."""
    return table(spark, d, "content_file").select("tax", F.explode(split_list(F.col("accessions"))).alias("accession")).distinct()


def content_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Places of the taxa in the content file, by number."""
    return content.ordinals(table(spark, d, "content_file").where("tax is not null"))


def content_ordinals_as_text(spark: SparkSession, d: str) -> DataFrame:
    """The same with taxa as text."""
    return content.ordinals(table(spark, d, "content_file").where("tax is not null"), as_text=True)


def frequency_file(spark: SparkSession, d: str) -> DataFrame:
    """The wide frequency table, one column for each k."""
    f = table(spark, d, "freq").where("tax is not null").groupBy("shard_id", "tax", "k").agg(F.max("n").alias("n"))
    return f.groupBy("shard_id", "tax").agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(f"k{k}") for k in range(12, 0, -1)])


def frequency_totals(spark: SparkSession, d: str) -> DataFrame:
    """A8, merged over shards: rows of each taxon for every k, delivered rows counted once."""
    f = table(spark, d, "freq").where("tax is not null").groupBy("shard_id", "tax", "k").agg(F.max("n").alias("n"))
    return f.groupBy("tax", "k").agg(F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        taxonomy_names, taxonomy_paths, taxonomy_lift, accession_lookup, content_generate_species, content_generate_genus, content_generate_lowest, content_numbered, content_merge, content_dummies_renamed, content_repair,
        content_generate_species_headers, content_generate_genus_headers, content_generate_lowest_headers, content_numbered_headers, content_merge_headers, content_dummies_renamed_headers, content_repair_headers,
        content_accessions, content_ordinals, content_ordinals_as_text, frequency_file, frequency_totals,
    )
}

_NODES = "nodes as (select tax, min(parent) as parent, min(rank_name) as rank_name from tax_nodes where tax is not null and parent is not null group by tax)"
_UP = """up(tax, ancestor, parent, rank_name, depth) as (select tax, tax, parent, rank_name, 0 from nodes
        union all select u.tax, n.tax, n.parent, n.rank_name, u.depth + 1 from up u join nodes n on n.tax = u.parent where u.parent <> u.ancestor)"""
_ACC = f"acc as (select distinct {q.accession('name')} as accession from read_chunks where name is not null and {q.accession('name')} is not null)"
_HEADERS = f"acc as (select distinct coalesce({q.accession('name')}, trim(name, chr(32) || chr(9) || chr(10) || chr(13))) as accession from read_chunks where trim(name, chr(32) || chr(9) || chr(10) || chr(13)) <> '')"
_MAP = "mp as (select accession, min(tax) as tax from acc_map where tax is not null group by accession)"
_NAMES = "nm as (select tax, min(name) as name from tax_names where name_class = 'scientific name' and tax is not null group by tax)"


def _lift(source: str, rank: str) -> str:
    return f"""lv as (select tax, min_by(ancestor, depth) as a, min_by(parent, depth) as p from up where rank_name = '{rank}' group by tax),
    lf as (select s.tax, case when a is null or p = 1 then s.tax else a end as upper from (select distinct tax from {source} where tax is not null) s left join lv using (tax))"""


def _generate(level: str | None) -> str:
    lift = _lift("mp", level) if level else "lf as (select distinct tax, tax as upper from mp)"
    return f"""{_NODES}, {_UP}, {_ACC}, {_MAP}, {_NAMES}, {lift},
    fd as (select accession, tax from acc left join mp using (accession)),
    gr as (select upper as tax, list(distinct fd.tax order by fd.tax) as subs, list(distinct accession order by accession) as accs from fd join lf using (tax) group by upper),
    gn as (select gr.*, name, row_number() over (partition by name is null order by tax) - 1 as i from gr left join nm using (tax)),
    ls as (select accession, row_number() over (order by accession) - 1 as i from fd where tax is null),
    gen as (select case when name is null then 'unnamed_' || i else replace(name, ',', '') end as name, tax, subs, accs from gn
            union all select 'EWAN_' || i, 4294967294 - i, [4294967294 - i], [accession] from ls)"""


_JOIN = "select name, tax, array_to_string(subs, ';') as sub_taxids, array_to_string(accs, ';') as accessions from"
_CONTENT = "cf as (select name, tax, list_transform(list_filter(string_split(coalesce(sub_taxids, ''), ';'), lambda x: x <> ''), lambda x: x::bigint) as subs, list_filter(string_split(coalesce(accessions, ''), ';'), lambda x: x <> '') as accs from content_file)"
_BOTH = "bt as (select 1 as side, name, tax, subs, accs from cf union all select 2, name, tax, subs, accs from gen)"
_DUM = "dm as (select *, row_number() over (order by side, tax desc) - 1 as i from bt where coalesce(starts_with(name, 'EWAN_'), false))"

SQL = {
    "taxonomy_names": f"with {_NAMES} select tax, replace(name, ',', ' ') as name from nm",
    "taxonomy_paths": f"with recursive {_NODES}, {_UP} select tax, ancestor, rank_name, depth from up",
    "taxonomy_lift": f"with recursive {_NODES}, {_UP}, {_lift('acc_map', 'genus')} select * from lf",
    "accession_lookup": f"with {_ACC}, {_MAP} select accession, tax from acc left join mp using (accession)",
    "content_generate_species": f"with recursive {_generate('species')} {_JOIN} gen",
    "content_generate_genus": f"with recursive {_generate('genus')} {_JOIN} gen",
    "content_generate_lowest": f"with recursive {_generate(None)} {_JOIN} gen",
    "content_numbered": f"with {_ACC} select accession, row_number() over (order by accession) as tax from acc",
    "content_merge": f"""with recursive {_generate('species')}, {_CONTENT}, {_BOTH}, {_DUM},
        rl as (select max_by(name, side) filter (name is not null) as name, tax, list_sort(list_distinct(flatten(list(subs)))) as subs, list_sort(list_distinct(flatten(list(accs)))) as accs from bt where not coalesce(starts_with(name, 'EWAN_'), false) group by tax),
        al as (select * from rl union all select 'EWAN_' || i, 4294967295 - i, [4294967295 - i], accs from dm) {_JOIN} al""",
    "content_dummies_renamed": f"with recursive {_generate('species')}, {_CONTENT}, {_BOTH}, {_DUM} select side, tax as old, 4294967295 - i as new from dm",
    "content_repair": f"""with recursive {_generate(None)}, {_CONTENT}, {_BOTH},
        rl as (select max(name) as name, tax, list_sort(list_distinct(flatten(list(subs)))) as subs, list_sort(list_distinct(flatten(list(accs)))) as accs from bt where tax is not null group by tax) {_JOIN} rl""",
    "content_accessions": "select distinct tax, unnest(list_filter(string_split(coalesce(accessions, ''), ';'), lambda x: x <> '')) as accession from content_file",
    "content_ordinals": "select row_number() over (order by tax) as ordinal, tax, name from content_file where tax is not null",
    "content_ordinals_as_text": "select row_number() over (order by tax::varchar) as ordinal, tax, name from content_file where tax is not null",
    "frequency_file": f"with f as (select shard_id, tax, k, max(n) as n from freq where tax is not null group by all) select shard_id, tax, {', '.join(f'max(n) filter (k = {k}) as k{k}' for k in range(12, 0, -1))} from f group by shard_id, tax",
    "frequency_totals": "with f as (select shard_id, tax, k, max(n) as n from freq where tax is not null group by all) select tax, k, sum(n)::bigint as n from f group by tax, k",
}

SQL |= {
    f"{name}_headers": SQL[name].replace(_ACC, _HEADERS)
    for name in ("content_generate_species", "content_generate_genus", "content_generate_lowest", "content_numbered", "content_merge", "content_dummies_renamed", "content_repair")
}
