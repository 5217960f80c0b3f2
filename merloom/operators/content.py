"""The content table: taxa with their lowest taxa and accessions.

Rows are (name, tax, sub_taxids, accessions), the lists as sorted arrays. Null
names become ``unnamed_i`` in order of taxon; entries without a taxon get dummy
ids counted down from just under 2^32 in order of accession.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merloom.functions.text import clean_name, split_list
from merloom.operators import reports
from merloom.operators.sequence_store import ranked

# Names and first ids of entries without accession number.
DUMMY_NAME = "EWAN_"
FIRST_DUMMY = 2**32 - 2
FIRST_DUMMY_MERGED = 2**32 - 1
LEVELS = ("subspecies", "species", "genus", "family", "order", "class", "phylum", "kingdom", "superkingdom", "domain")


def level_or_default(level: str) -> str:
    """Unknown levels mean species; ``lowest`` keeps every taxon."""
    return level if level in LEVELS or level == "lowest" else "species"


def scientific_names(names: DataFrame) -> DataFrame:
    """(tax, name): one scientific name for each taxon, the first in order."""
    return names.where("name_class = 'scientific name' and tax is not null").groupBy("tax").agg(F.min("name").alias("name"))


def accession_taxa(accessions: DataFrame, acc_map: DataFrame) -> DataFrame:
    """(accession, tax): each wanted accession with its taxon, null if the map has none; of several the least."""
    known = acc_map.where("tax is not null").groupBy("accession").agg(F.min("tax").alias("tax"))
    return accessions.select("accession").where("accession is not null").distinct().join(known, "accession", "left")


def generate(accessions: DataFrame, acc_map: DataFrame, nodes: DataFrame, names: DataFrame, level: str = "species") -> DataFrame:
    """The content table of all accessions, lifted to a taxonomic level."""
    found = accession_taxa(accessions, acc_map)
    have, lost = found.where("tax is not null"), found.where("tax is null")
    level = level_or_default(level)
    up = reports.lift(nodes, have, level) if level != "lowest" else have.select("tax", F.col("tax").alias("upper")).distinct()
    grouped = have.join(up, "tax").groupBy(F.col("upper").alias("tax")).agg(F.array_sort(F.collect_set("tax")).alias("sub_taxids"), F.array_sort(F.collect_set("accession")).alias("accessions"))
    named = grouped.join(scientific_names(names), "tax", "left")
    ok = named.where("name is not null").select(clean_name(F.col("name")).alias("name"), "tax", "sub_taxids", "accessions")
    no_name = ranked(named.where("name is null").drop("name"), F.col("tax"), name="i", start=0)
    no = no_name.select(F.concat(F.lit("unnamed_"), F.col("i").cast("string")).alias("name"), "tax", "sub_taxids", "accessions")
    lost = ranked(lost.select("accession"), F.col("accession"), name="i", start=0).withColumn("tax", (F.lit(FIRST_DUMMY) - F.col("i")).cast("long"))
    dummy = lost.select(F.concat(F.lit(DUMMY_NAME), F.col("i").cast("string")).alias("name"), "tax", F.array("tax").alias("sub_taxids"), F.array("accession").alias("accessions"))
    return ok.unionByName(no).unionByName(dummy)


def generate_lowest_numbered(accessions: DataFrame) -> DataFrame:
    """(accession, tax): accessions numbered from 1 in their order, for use without a taxonomy."""
    a = accessions.select("accession").where("accession is not null").distinct()
    return ranked(a, F.col("accession"), name="tax").select("accession", F.col("tax").cast("long").alias("tax"))


def parse(content: DataFrame) -> DataFrame:
    """Joined lists as arrays; taxa in lists as numbers."""
    return content.select("name", "tax", F.transform(split_list(F.col("sub_taxids")), lambda x: x.try_cast("long")).alias("sub_taxids"), split_list(F.col("accessions")).alias("accessions"))


def _is_dummy(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit(DUMMY_NAME)), F.lit(False))


def repair(content: DataFrame) -> DataFrame:
    """One row for each taxon: lists united, without repeats; the last name in order."""
    return content.where("tax is not null").groupBy("tax").agg(
        F.max("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sub_taxids")))).alias("sub_taxids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("accessions")))).alias("accessions")
    ).select("name", "tax", "sub_taxids", "accessions")


def merge(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, renamed): taxa of both, lists united, the name of ``b`` before that of ``a``; and the dummies' (side, old, new).

    Dummies of both sides are entries of their own and numbered anew.
    """
    x = a.select(F.lit(1).alias("side"), "name", "tax", "sub_taxids", "accessions").unionByName(b.select(F.lit(2).alias("side"), "name", "tax", "sub_taxids", "accessions"))
    real = x.where(~_is_dummy(F.col("name"))).groupBy("tax").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("side"))).alias("name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sub_taxids")))).alias("sub_taxids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("accessions")))).alias("accessions"),
    )
    dummies = ranked(x.where(_is_dummy(F.col("name"))), F.col("side"), F.desc("tax"), F.array_join("accessions", ";"), name="i", start=0)
    dummies = dummies.withColumn("new", (F.lit(FIRST_DUMMY_MERGED) - F.col("i")).cast("long"))
    rows = dummies.select(F.concat(F.lit(DUMMY_NAME), F.col("i").cast("string")).alias("name"), F.col("new").alias("tax"), F.array("new").alias("sub_taxids"), "accessions")
    return real.select("name", "tax", "sub_taxids", "accessions").unionByName(rows), dummies.select("side", F.col("tax").alias("old"), "new")


def joined(content: DataFrame) -> DataFrame:
    """The file form: lists joined with ``;``."""
    return content.select("name", "tax", F.array_join(F.col("sub_taxids").cast("array<string>"), ";").alias("sub_taxids"), F.array_join("accessions", ";").alias("accessions"))


def ordinals(content: DataFrame, as_text: bool = False) -> DataFrame:
    """(ordinal, tax, name): places in the content file, from 1; by number, or as text."""
    key = F.col("tax").cast("string") if as_text else F.col("tax")
    return ranked(content.select("tax", "name"), key, F.col("name"), name="ordinal").select("ordinal", "tax", "name")
