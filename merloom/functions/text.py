"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accession_of(header: Column) -> Column:
    """The first piece with a dot among the pipe-separated pieces of the first word of a header; null if none."""
    word = F.split(F.trim(header), "\\s+").getItem(0)
    return F.try_element_at(F.filter(F.split(word, "\\|"), lambda x: F.contains(x, F.lit("."))), F.lit(1))


def clean_name(name: Column) -> Column:
    """Without commas, as written to content files."""
    return F.translate(name, ",", "")


def comma_to_blank(name: Column) -> Column:
    return F.translate(name, ",", " ")


def trim_all(c: Column) -> Column:
    """Without blanks, tabs and line ends at either side."""
    return F.regexp_replace(c, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")


def split_list(c: Column, sep: str = ";") -> Column:
    """Pieces of a joined list; null and empty pieces are left out."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), sep), lambda x: x != "")


def split_first(c: Column, sep: str) -> Column:
    """array of two: before and after the first separator."""
    return F.split(c, sep, 2)


def split_longs(c: Column, sep: str = ";") -> Column:
    return F.transform(split_list(c, sep), lambda x: x.try_cast("long"))


def file_stem(path: Column) -> Column:
    """The file name without folders and without its last suffix (``.gz`` is taken off first)."""
    name = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "\\.gz$", "")
    return F.regexp_replace(name, "\\.[^.]*$", "")


def bits_set(c: Column) -> Column:
    return F.bit_count(c)


def highest_bit(c: Column) -> Column:
    """Position of the highest set bit of a positive number."""
    return F.floor(F.log2(c))


def lookup(table: dict, key: Column, default: Column | None = None, what: str = "key") -> Column:
    """Value of a key in a small table given as literals; a missing key gives ``default``, or raises where there is none."""
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)
    return F.coalesce(found, default if default is not None else F.raise_error(F.concat(F.lit(f"unknown {what}: "), key.cast("string"))))
