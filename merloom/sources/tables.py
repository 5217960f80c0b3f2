"""Scans of taxonomy dumps, accession maps, content and frequency files, code tables and settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merloom.functions.codec import codon_table
from merloom.functions.text import trim_all
from merloom.session import read_text


def _dump(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a dump whose fields end in tab, pipe, tab."""
    return spark.read.text(path).select(F.transform(F.split(F.regexp_replace("value", "\\t?\\|\\s*$", ""), "\\|"), lambda x: trim_all(x)).alias("f"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    f = lambda i: F.try_element_at("f", F.lit(i))
    return _dump(spark, path).select(f(1).try_cast("long").alias("tax"), f(2).try_cast("long").alias("parent"), F.nullif(f(3), F.lit("")).alias("rank_name"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    f = lambda i: F.try_element_at("f", F.lit(i))
    return _dump(spark, path).select(f(1).try_cast("long").alias("tax"), f(2).alias("name"), F.nullif(f(3), F.lit("")).alias("unique_name"), f(4).alias("name_class"))


def read_deleted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\\t").getItem(0).try_cast("long").alias("tax")).where("tax is not null")


def read_accession_map(spark: SparkSession, path: str) -> DataFrame:
    """Two columns (accession, taxid) or four (the second and third); a header line has no number and gives a null taxon, and is left out."""
    f = F.split("value", "\\t")
    four = F.size(f) >= 4
    x = spark.read.text(path).select(F.when(four, F.get(f, F.lit(1))).otherwise(F.get(f, F.lit(0))).alias("accession"), F.when(four, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("t"))
    return x.where("t is null or t = '' or t rlike '^[0-9]+$'").select("accession", F.nullif("t", F.lit("")).cast("long").alias("tax"))


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """(name, tax, sub_taxids, accessions, line_no): four columns, or five where taxa are text; fewer raise."""
    f = F.split("value", "\\t")
    ok = F.when(F.size(f) >= 4, F.lit(True)).otherwise(F.raise_error(F.lit("Content files have four columns at least.")).cast("boolean"))
    get = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit(""))
    return spark.read.text(path).where(ok).select(get(0).alias("name"), get(1).alias("tax"), get(2).alias("sub_taxids"), get(3).alias("accessions"), get(4).try_cast("long").alias("line_no"))


def read_frequencies(spark: SparkSession, path: str, h: int = 12) -> DataFrame:
    """(line_no, name, k, n) of a wide frequency file, one column for each k from h to 1."""
    f = F.split("value", "\\t")
    rows = spark.read.text(path).select(F.get(f, F.lit(0)).alias("name"), F.explode(F.array(*[F.struct(F.lit(h - i).alias("k"), F.get(f, F.lit(i + 1)).try_cast("long").alias("n")) for i in range(h)])).alias("r"))
    return rows.select("name", "r.k", "r.n")


def read_code_table(path: str, code_id: int) -> dict[str, str] | None:
    """Triple -> letter of one code of a ``gc.prt`` file: the record of the id, then amino acids, starts and the three bases; None if missing."""
    lines = read_text(SparkSession.active(), path).splitlines()
    for i, line in enumerate(lines):
        if re.match(rf"\s*id\s+{code_id}\s*,", line):
            amino = re.search(r'"([^"]*)"', lines[i + 1])
            bases = [re.sub(r".*Base\d\s*", "", x).strip() for x in lines[i + 3 : i + 6]]
            if amino and len(bases) == 3:
                return codon_table(amino.group(1), *bases)
    return None


def read_pair_map(path: str) -> dict[tuple[int, int], int]:
    """(letter code, letter code) -> letter code from lines ``AB,C``."""
    out = {}
    for line in read_text(SparkSession.active(), path).splitlines():
        m = re.match(r"\s*(\S)(\S)\s*,\s*(\S)", line)
        if m:
            out[(ord(m[1]) & 31, ord(m[2]) & 31)] = ord(m[3]) & 31
    return out


def read_settings(path: str) -> dict[str, str]:
    """Flat ``key: value`` lines; indentation, comments and section lines without a value are ignored."""
    out = {}
    for line in read_text(SparkSession.active(), path).splitlines():
        line = line.split("#", 1)[0]
        key, sep, value = line.strip().partition(":")
        if sep and value.strip():
            out[key.strip()] = value.strip().strip("'\"")
    return out
