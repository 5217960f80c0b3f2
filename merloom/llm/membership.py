"""Distinct counts over huge identifier sets by membership patterns.

Each identifier is reduced to the sorted set of cells (smallest groups) that
contain it; identifiers with the same set are counted together. The totals of
the patterns answer every combination of groups exactly (the error bound is
0): the distinct identifiers of a union of groups are those whose pattern
touches any of them, of an intersection those whose pattern touches all.
Pattern totals of disjoint sets of identifiers add up, so partial results of
hash ranges of identifiers are mergeable; sets of identifiers (``member_sets``)
merge whatever they share, so a new day is added to what is stored.

Skew: (identifier, cell) pairs are made distinct first, combined before the
shuffle and spread over both columns; what is then gathered by identifier is at
most one entry a cell.

Cases: null identifiers are in no pattern; a null day or shard is no group, but
the row still counts for its other group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_BITS = 31
ALL = -1  # over all of the other dimension
NONE = -2  # the row has no value there


def cell_code(day: Column, shard: Column) -> Column:
    """One bigint for a (day number, shard) pair; either may be null or ALL."""
    d = F.coalesce(day.cast("long"), F.lit(NONE)) + 1_000_000
    s = F.coalesce(shard.cast("long"), F.lit(NONE)) + 2
    return F.shiftleft(d, SHARD_BITS).bitwiseOR(s)


def cell_day(c: Column) -> Column:
    return F.shiftright(c, SHARD_BITS) - 1_000_000


def cell_shard(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << SHARD_BITS) - 1)) - 2


def member_sets(df: DataFrame, ident: Column, cell: Column) -> DataFrame:
    """(ident, pattern array<bigint>): each identifier with the sorted set of its cells; can be stored and merged."""
    pairs = df.select(ident.alias("ident"), cell.alias("cell")).where(F.col("ident").isNotNull() & F.col("cell").isNotNull()).distinct()
    return pairs.groupBy("ident").agg(F.array_sort(F.collect_list("cell")).alias("pattern"))


def merge_sets(*parts: DataFrame) -> DataFrame:
    """Sets of partial tables that may share identifiers and cells, as those of a new day and of all days before."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("ident").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pattern")))).alias("pattern"))


def patterns_of(sets: DataFrame) -> DataFrame:
    """(pattern, n): identifiers counted by their set."""
    return sets.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def patterns(df: DataFrame, ident: Column, cell: Column) -> DataFrame:
    """(pattern array<bigint>, n): how many identifiers occur in exactly these cells."""
    return patterns_of(member_sets(df, ident, cell))


def merge_patterns(*parts: DataFrame) -> DataFrame:
    """Totals of disjoint sets of identifiers."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("pattern").agg(F.sum("n").alias("n"))


def count_any(pats: DataFrame, cells: Column) -> DataFrame:
    """Distinct identifiers in the union of the cells."""
    return pats.where(F.arrays_overlap("pattern", cells)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def count_all(pats: DataFrame, groups: list[Column]) -> DataFrame:
    """Distinct identifiers that occur in every one of the groups, each an array of cells."""
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.arrays_overlap("pattern", g)
    return pats.where(cond).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def cube_groups(pattern: Column) -> Column:
    """The cells of a pattern, its days over all shards and its shards over all days."""
    cells = F.filter(pattern, lambda c: (cell_day(c) != NONE) & (cell_shard(c) != NONE))
    days = F.filter(F.array_distinct(F.transform(pattern, lambda c: cell_code(cell_day(c), F.lit(ALL)))), lambda c: cell_day(c) != NONE)
    shards = F.filter(F.array_distinct(F.transform(pattern, lambda c: cell_code(F.lit(ALL), cell_shard(c)))), lambda c: cell_shard(c) != NONE)
    return F.concat(cells, days, shards)


def distinct_by_cube(pats: DataFrame) -> DataFrame:
    """(grp, n_distinct) for each cell, each day and each shard, from pattern totals."""
    return pats.select(F.explode(cube_groups(F.col("pattern"))).alias("grp"), "n").groupBy("grp").agg(F.sum("n").alias("n_distinct"))


def rows_by_cube(df: DataFrame, cell: Column, ident: Column) -> DataFrame:
    """(grp, n_rows, n_ident): rows and rows with an identifier for the same groups."""
    per = df.select(cell.alias("cell"), ident.alias("ident")).groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.count("ident").alias("filled"))
    return per.select(F.explode(cube_groups(F.array("cell"))).alias("grp"), "rows", "filled").groupBy("grp").agg(F.sum("rows").alias("n_rows"), F.sum("filled").alias("n_ident"))
