"""The (code, tax) index: build, maintenance, statistics and shrinking.

An index is a DataFrame (code bigint, tax bigint), distinct; ``store`` sorts
it by range so that file statistics serve as its directory. Rows with a null
code or tax are no index rows and are left out by ``build``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.functions.codec import H64, decode_kmer, encode_kmer, kmer_prefix_code, pads_at
from merloom.functions.scoring import entropy
from merloom.session import materialise

PAD_CODE = 30


def letter(code: Column, k: int, h: int = H64) -> Column:
    """Code of the k-th letter."""
    return F.shiftright(code, 5 * (h - k)).bitwiseAND(F.lit(31).cast("long"))


def build(pairs: DataFrame, code: Column, tax: Column) -> DataFrame:
    return pairs.select(code.alias("code"), tax.alias("tax")).where("code is not null and tax is not null").distinct()


def store(idx: DataFrame, path: str, files: int | None = None, mode: str = "error") -> None:
    """Write sorted by (code, tax) in ranges of code; statistics of the files prune lookups."""
    ranged = idx.repartitionByRange(files, "code") if files else idx.repartitionByRange("code")
    ranged.sortWithinPartitions("code", "tax").write.mode(mode).parquet(path)


def merge(a: DataFrame, b: DataFrame, remap_a: DataFrame | None = None, remap_b: DataFrame | None = None) -> DataFrame:
    """Union of two indices; taxa are renamed first, by tables (old, new) of dummies (small)."""

    def renamed(x: DataFrame, m: DataFrame | None) -> DataFrame:
        if m is None:
            return x.select("code", "tax")
        return x.join(m, x["tax"] == m["old"], "left").select("code", F.coalesce("new", "tax").alias("tax"))

    return renamed(a, remap_a).unionByName(renamed(b, remap_b)).distinct()


def update(idx: DataFrame, new_rows: DataFrame, remap: DataFrame | None = None) -> DataFrame:
    return merge(idx, new_rows, remap)


def delete(idx: DataFrame, taxa: DataFrame) -> DataFrame:
    """Without the rows of the listed taxa; null taxa in the list match nothing."""
    return idx.join(taxa.select("tax").where("tax is not null"), "tax", "left_anti").select("code", "tax")


def frequencies(idx: DataFrame, h: int = H64) -> DataFrame:
    """(tax, k, n): rows of every taxon whose k-th letter is no padding, for k from h to 1."""
    counts = idx.groupBy("tax").agg(*[F.count_if(~pads_at(F.col("code"), k, h)).alias(f"k{k}") for k in range(h, 0, -1)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("n")) for k in range(h, 0, -1)])).alias("r")
    return counts.select("tax", rows).select("tax", "r.k", "r.n")


def starts(counts: DataFrame, keys: list[str], letters: int) -> DataFrame:
    """``counts`` (keys..., prefix, cnt) with ``start``: the sum of cnt over smaller prefixes of the same keys.

    Sums go two letters at a time: the start of a prefix is that of its parent
    plus the sum over its smaller siblings. No window has more than 1,024
    rows, however the prefixes are spread. The counts are written once, since
    every level reads them.
    """
    return _starts(materialise(counts), keys, letters)


def _starts(counts: DataFrame, keys: list[str], letters: int) -> DataFrame:
    before = lambda w: F.coalesce(F.sum("cnt").over(w.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if letters <= 2:
        return counts.withColumn("start", before(Window.partitionBy(*(keys or [F.lit(0)]))))
    x = counts.withColumn("parent", F.shiftright("prefix", 10))
    up = x.groupBy(*keys, F.col("parent").alias("prefix")).agg(F.sum("cnt").alias("cnt"))
    up = _starts(up, keys, letters - 2).select(*keys, F.col("prefix").alias("parent"), F.col("start").alias("base"))
    x = x.withColumn("within", before(Window.partitionBy(*keys, "parent"))).join(up, [*keys, "parent"])
    return x.select(*keys, "prefix", "cnt", (F.col("base") + F.col("within")).alias("start"))


def directory(idx: DataFrame, letters: int = 6, h: int = H64) -> DataFrame:
    """(prefix, start, cnt): where the rows of every prefix begin in the sorted index and how many they are."""
    first = kmer_prefix_code(F.col("code"), letters, h) if h <= H64 else encode_kmer(F.substring("code", 1, letters), letters)
    p = idx.groupBy(first.alias("prefix")).agg(F.count(F.lit(1)).alias("cnt"))
    return starts(p, [], letters).select("prefix", "start", "cnt")


def taxa_per_kmer(idx: DataFrame) -> DataFrame:
    """(code, n_taxa)."""
    return idx.groupBy("code").agg(F.count(F.lit(1)).alias("n_taxa"))


def redundancy(idx: DataFrame) -> DataFrame:
    """(n_taxa, n_kmers, share, cumulative): k-mers by their number of taxa, with the share of index rows."""
    h = taxa_per_kmer(idx).groupBy("n_taxa").agg(F.count(F.lit(1)).alias("n_kmers"))
    rows = (F.col("n_taxa") * F.col("n_kmers")).cast("double")
    one = Window.partitionBy(F.lit(0))  # one row for each number of taxa: few
    run = one.orderBy("n_taxa").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return h.select("n_taxa", "n_kmers", (rows / F.sum(rows).over(one)).alias("share"), (F.sum(rows).over(run) / F.sum(rows).over(one)).alias("cumulative"))


def redundancy_cutoff(idx: DataFrame, share: float = 0.99) -> DataFrame:
    """One row: the least number of taxa whose cumulative share reaches ``share``, and the verdict on the index."""
    n = redundancy(idx).where(F.col("cumulative") >= share - 1e-12).agg(F.min("n_taxa").alias("cutoff"))
    return n.withColumn("verdict", F.when(F.col("cutoff") == 1, "unique").when(F.col("cutoff") < 4, "low").otherwise("high"))


def shrink_every_nth(idx: DataFrame, percent: float) -> DataFrame:
    """Without ``percent`` % of the rows of every taxon, evenly spaced in index order.

    A row's number within its taxon is its rank within six letters plus the
    start of these, so a taxon that holds a third of all rows is not ranked in
    one task.
    """
    step = 100.0 / percent
    x = idx.withColumn("prefix", kmer_prefix_code(F.col("code"), 6))
    offs = starts(x.groupBy("tax", "prefix").agg(F.count(F.lit(1)).alias("cnt")), ["tax"], 6).select("tax", "prefix", "start")
    rank = F.row_number().over(Window.partitionBy("tax", "prefix").orderBy("code"))
    numbered = x.withColumn("r", rank).join(offs, ["tax", "prefix"]).withColumn("rn", F.col("start") + F.col("r"))
    hit = F.floor(F.ceil(F.col("rn") / F.lit(step)) * F.lit(step)) == F.col("rn")
    return numbered.where(~hit).select("code", "tax")


def percent_for_size(rows: int, row_bytes: int, target_bytes: int) -> float:
    """Percentage to drop so that the rest fits a target size."""
    return max(0.0, min(100.0, 100.0 * (1 - target_bytes / max(1, rows * row_bytes))))


def shrink_entropy(idx: DataFrame, least: float = 0.5) -> DataFrame:
    return idx.where(entropy(decode_kmer(F.col("code"))) > least)


def shrink_halve(idx: DataFrame) -> DataFrame:
    """(prefix, suffix, tax): six letters each, in place of one code; rows whose last six letters are all padding are dropped."""
    low = F.col("code").bitwiseAND(F.lit((1 << 30) - 1).cast("long"))
    all_pad = sum(PAD_CODE << (5 * i) for i in range(6))
    return idx.where(low != all_pad).select(kmer_prefix_code(F.col("code"), 6).alias("prefix"), low.cast("int").alias("suffix"), "tax")


def from_halved(halved: DataFrame) -> DataFrame:
    """The (code, tax) rows of a halved index; it can match at seven letters and more."""
    return halved.select(F.shiftleft(F.col("prefix").cast("long"), 30).bitwiseOR(F.col("suffix").cast("long")).alias("code"), "tax")


def shrink_overrepresented(idx: DataFrame, limit: int = 3) -> DataFrame:
    """Only k-mers of at most ``limit`` taxa."""
    few = taxa_per_kmer(idx).where(F.col("n_taxa") <= limit).select("code")
    return idx.join(few, "code", "left_semi").select("code", "tax")


def frequent_kmers(idx: DataFrame, least: int = 4) -> DataFrame:
    """(code, n_taxa, taxa): k-mers with at least ``least`` entries."""
    g = idx.groupBy("code").agg(F.count(F.lit(1)).alias("n_taxa"), F.array_sort(F.collect_list("tax")).alias("taxa"))
    return g.where(F.col("n_taxa") >= least)


def csr(idx: DataFrame) -> DataFrame:
    """(code, start, taxa): distinct k-mers with the offset of their taxa in the list of all."""
    g = idx.groupBy("code").agg(F.array_sort(F.collect_list("tax")).alias("taxa"))
    d = directory(idx, H64).select(F.col("prefix").alias("c"), "start")
    return g.join(d, F.col("code") == F.col("c")).select("code", "start", "taxa")


def lookup(idx: DataFrame, codes: DataFrame) -> DataFrame:
    """Index rows of the listed codes."""
    return idx.join(codes.select("code").where("code is not null").distinct(), "code")


def repack_odd_letters(idx: DataFrame, h: int = H64) -> DataFrame:
    """(code, tax): six-letter k-mers of the letters 1, 3, 5, ... (a legacy layout), distinct."""
    out = F.lit(0).cast("long")
    for i, k in enumerate(range(1, h, 2)):
        out = out.bitwiseOR(F.shiftleft(letter(F.col("code"), k, h), 5 * (h // 2 - 1 - i)))
    return idx.select(out.alias("code"), "tax").distinct()


def hash_pairs(idx: DataFrame, h: int = H64, pair_map: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """(code, tax): each pair of letters hashed to one; by default (a * 5 + b * 3) modulo 26, plus 1."""
    out = F.lit(0).cast("long")
    for i in range(0, h, 2):
        a, b = letter(F.col("code"), i + 1, h), letter(F.col("code"), i + 2, h)
        if pair_map:
            m = F.create_map(*[F.lit(int(x)) for (p, q), v in sorted(pair_map.items()) for x in (p * 32 + q, v)])
            one = F.coalesce(F.try_element_at(m, (a * 32 + b).cast("int")), F.lit(0)).cast("long")
        else:
            one = F.pmod(a * 5 + b * 3, F.lit(26)) + 1
        out = F.shiftleft(out, 5).bitwiseOR(one)
    return idx.select(out.alias("code"), "tax").distinct()
