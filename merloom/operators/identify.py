"""Identification: prefix joins of read windows with the index for every k, scores and profiles.

For k in min_k..max_k and a k-letter prefix p whose last letter is no padding:
T(k, p) are the distinct taxa of index rows that start with p, and every read
window that starts with p is a hit. A hit adds k^2/625/|T| to the score of its
read and each taxon of T, 1/|T| to the counts of the taxon, and 1 to its unique
counts if |T| = 1.

Plan: windows whose min_k prefix is not in the index are dropped by a semi join
first; what is left is counted by read and code and written once, as both sides
need it. Of the index only rows whose min_k prefix occurs in the reads are
taken, and of both sides longer prefixes only where the next letter agrees too,
so the cost of a query follows its matches, not the size of the index. The
index side is one row for each (k, prefix) with its taxa as an array, so a join
row fans out only when taxa are exploded, and counts are combined map-side. A
prefix shared by many reads is split by adaptive skew joins.

Keys of an index of up to 12 letters are packed codes, of 25 letters text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merloom.functions import scoring
from merloom.functions.codec import H64, code_prefix, pads_at
from merloom.session import materialise, small


def prefixes(df: DataFrame, keep: Sequence[str], min_k: int, max_k: int, h: int = H64) -> DataFrame:
    """(keep..., k, prefix): the prefixes of each code whose last letter is no padding."""
    each = F.array(*[F.when(~pads_at(F.col("code"), k, h), F.struct(F.lit(k).alias("k"), code_prefix(F.col("code"), k, h).alias("prefix"))) for k in range(min_k, max_k + 1)])
    return df.select(*keep, F.explode(each).alias("e")).where("e is not null").select(*keep, "e.k", "e.prefix")


def _begins(df: DataFrame, k: int, h: int, name: str) -> DataFrame:
    """The distinct k-letter prefixes."""
    return df.select(code_prefix(F.col("code"), k, h).alias(name)).distinct()


def _sharing(df: DataFrame, other: DataFrame, k: int, h: int) -> DataFrame:
    """Rows whose first k letters begin a code of the other side."""
    return df.withColumn("__p", code_prefix(F.col("code"), k, h)).join(_begins(other, k, h, "__p"), "__p", "left_semi").drop("__p")


def _levels(df: DataFrame, other: DataFrame, keep: Sequence[str], min_k: int, max_k: int, h: int, shared: bool = False) -> DataFrame:
    """(keep..., k, prefix) of rows that share min_k letters with the other side (all do if ``shared``); longer prefixes where they share one letter more."""
    out = prefixes(df if shared else _sharing(df, other, min_k, h), keep, min_k, min_k, h)
    if max_k > min_k:
        out = out.unionByName(prefixes(_sharing(df, other, min_k + 1, h), keep, min_k + 1, max_k, h))
    return out


def index_prefixes(idx: DataFrame, min_k: int, max_k: int, h: int = H64) -> DataFrame:
    """(k, prefix, taxa, n_taxa): the taxa of each prefix of the whole index; can be stored beside it."""
    return _taxa(prefixes(idx, ["tax"], min_k, max_k, h))


def _taxa(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k", "prefix").agg(F.collect_set("tax").alias("taxa")).withColumn("n_taxa", F.size("taxa").cast("long"))


def live(windows: DataFrame, idx: DataFrame, min_k: int, h: int = H64) -> DataFrame:
    """Windows whose min_k prefix occurs in the index. All others can match at no k, so this comes before any count or join."""
    return _sharing(windows, idx, min_k, h)


def occurrences(windows: DataFrame, idx: DataFrame, keys: Sequence[str], min_k: int, h: int = H64) -> DataFrame:
    """(keys..., code, n): windows that may match, counted and written once."""
    return materialise(live(windows.select(*keys, "code"), idx, min_k, h).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n")))


def match_counted(occ: DataFrame, idx: DataFrame, keys: Sequence[str], min_k: int, max_k: int, h: int = H64, unique: bool = False, combined: bool = True) -> DataFrame:
    """(keys..., k, prefix, cnt, taxa, n_taxa) of counted windows; several rows a prefix unless ``combined``."""
    counted = occ.withColumn("cnt", F.lit(1).cast("long") if unique else F.col("n"))
    hits = _levels(counted, idx, [*keys, "cnt"], min_k, max_k, h, shared=True)
    if combined:
        hits = hits.groupBy(*keys, "k", "prefix").agg(F.sum("cnt").alias("cnt"))
    taxa = _taxa(_levels(idx, occ, ["tax"], min_k, max_k, h))
    # sides made by generators are larger than estimated: never broadcast them unmeasured
    return hits.hint("merge").join(taxa, ["k", "prefix"])


def match(windows: DataFrame, idx: DataFrame, keys: Sequence[str], min_k: int, max_k: int, h: int = H64, unique: bool = False, combined: bool = True) -> DataFrame:
    """(keys..., k, prefix, cnt, taxa, n_taxa); ``unique`` counts equal windows of a read once."""
    return match_counted(occurrences(windows, idx, keys, min_k, h), idx, keys, min_k, max_k, h, unique, combined)


def read_scores(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., tax, score, hits): weighted scores of each read and taxon."""
    w = F.col("cnt") * scoring.weight(F.col("k")) / F.col("n_taxa")
    rows = matched.select(*keys, F.explode("taxa").alias("tax"), w.alias("w"), "cnt")
    return rows.groupBy(*keys, "tax").agg(F.sum("w").alias("score"), F.sum("cnt").alias("hits"))


def taxon_counts(windows: DataFrame, idx: DataFrame, min_k: int, max_k: int, h: int = H64) -> DataFrame:
    """(tax, k, count_all, count_unique, count_total): the profile counts, without any read-wise work."""
    return count_taxa(match(windows, idx, [], min_k, max_k, h))


def count_taxa(matched: DataFrame) -> DataFrame:
    """(tax, k, count_all, count_unique, count_total) from (k, prefix, cnt, taxa, n_taxa), one row for each prefix."""
    rows = matched.select("k", F.explode("taxa").alias("tax"), (F.col("cnt") / F.col("n_taxa")).alias("a"), F.when(F.col("n_taxa") == 1, F.col("cnt")).otherwise(0).alias("u"))
    return rows.groupBy("tax", "k").agg(F.sum("a").alias("count_all"), F.sum("u").alias("count_unique"), F.count(F.lit(1)).alias("count_total"))


def rate(scores: DataFrame, reads: DataFrame, freq: DataFrame, keys: Sequence[str], min_k: int, max_k: int, frames: int = 3, threshold: float = 0.0, digits: int = 6, kind: str = "dna", h: int = H64) -> DataFrame:
    """Scores with relative score and error, rounded; rows under ``threshold`` are left out.

    ``reads`` has keys and seq_len, ``freq`` (tax, n) the index rows of each
    taxon at k = max_k. Protein reads are rated by their letters, DNA reads by their bases.
    """
    r = reads.select(*keys, "seq_len")
    x = scores.hint("merge").join(r, list(keys)).join(small(freq.select("tax", "n")), "tax", "left")
    best = scoring.best_score(F.col("seq_len"), min_k, max_k, frames, kind)
    x = x.withColumn("relative", F.round(scoring.relative_score(F.col("score"), F.coalesce("n", F.lit(1)), F.col("seq_len"), h, kind), digits))
    x = x.withColumn("error", F.round(scoring.error(F.col("score"), best), digits)).withColumn("score", F.round("score", digits))
    return x.where(F.col("relative") >= threshold).select(*keys, "seq_len", "tax", "score", "relative", "error")


def rank_hits(rated: DataFrame, keys: Sequence[str], beasts: int = 3, ratio: float = 0.8) -> DataFrame:
    """Rows of every read in order of relative score, marked as top or further hit; all others are left out.

    Top hits are the first row and those after it without a gap whose relative
    score exceeds ``ratio`` of the best, at most ``beasts``. Further hits follow
    while top hits plus changes of the k-mer score among further hits already
    given are fewer than ``beasts``. Ties are ordered by taxon.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("relative"), "tax")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    x = rated.withColumn("rank", F.row_number().over(w)).withColumn("most", F.first("relative").over(upto))
    good = (F.col("rank") == 1) | ((F.col("relative") / F.col("most") > ratio) & (F.col("rank") <= beasts))
    x = x.withColumn("good", good.cast("int")).withColumn("top", F.min("good").over(upto)).withColumn("n_top", F.sum("top").over(whole))
    change = (F.col("top") == 0) & ((F.lag("top").over(w) == 1) | (F.col("score") != F.lag("score").over(w)))
    x = x.withColumn("change", change.cast("int")).withColumn("before", F.coalesce(F.sum("change").over(prior), F.lit(0)))
    x = x.where((F.col("top") == 1) | (F.col("n_top") + F.col("before") < beasts))
    return x.select(*keys, "seq_len", F.col("rank").cast("long").alias("rank"), F.when(F.col("top") == 1, "top").otherwise("further").alias("hit"), "tax", "score", "relative", "error")


def longest_matches(windows: DataFrame, idx: DataFrame, keys: Sequence[str], min_k: int, max_k: int, h: int = H64) -> DataFrame:
    """(keys..., strand, pos, len): the longest matching prefix of every window that matches; the windows that may match are written once."""
    return longest_of(materialise(live(windows.select(*keys, "strand", "pos", "code"), idx, min_k, h)), idx, keys, min_k, max_k, h)


def longest_of(windows: DataFrame, idx: DataFrame, keys: Sequence[str], min_k: int, max_k: int, h: int = H64) -> DataFrame:
    """``longest_matches`` of written windows, most of which match."""
    codes = materialise(windows.select("code").distinct())
    stored = _levels(idx, codes, [], min_k, max_k, h).distinct()
    found = _levels(codes, idx, ["code"], min_k, max_k, h, shared=True).hint("merge").join(stored, ["k", "prefix"], "left_semi")
    best = found.groupBy("code").agg(F.max("k").alias("len"))
    return windows.hint("merge").join(best, "code").select(*keys, "strand", "pos", "len")


def coherence(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., coherence): matches of a read and strand in order of position form clusters while each begins
    at or before the end of the one before; a cluster is worth its greatest overlap + 1 - 1 / (how often it
    occurs), a read its best cluster; 0 without overlaps."""
    w = Window.partitionBy(*keys, "strand").orderBy("pos")
    x = matches.withColumn("last", F.lag(F.col("pos") + F.col("len")).over(w))
    joined = F.col("pos") <= F.col("last")
    x = x.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = F.when(joined, F.when(F.col("pos") + F.col("len") < F.col("last"), F.col("len")).otherwise(F.col("last") - F.col("pos")))
    per = x.withColumn("overlap", over).groupBy(*keys, "strand", "cluster", "overlap").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy(*keys, "strand", "cluster").agg(F.max(F.when(F.col("overlap").isNotNull(), F.struct("overlap", "n"))).alias("m"))
    value = F.col("m.overlap") + 1.0 - 1.0 / F.col("m.n")
    return top.groupBy(*keys).agg(F.coalesce(F.max(value), F.lit(0.0)).alias("coherence"))


def contaminated(rated: DataFrame, keys: Sequence[str], error_threshold: float = 0.5, coherent: DataFrame | None = None, coherence_threshold: float = 11.0) -> DataFrame:
    """Keys of the reads that match a taxon well: least error under the threshold, or coherence at least its threshold."""
    bad = rated.groupBy(*keys).agg(F.min("error").alias("e")).where(F.col("e") < error_threshold).select(*keys)
    if coherent is not None:
        bad = bad.unionByName(coherent.where(F.col("coherence") >= coherence_threshold).select(*keys)).distinct()
    return bad


def split_reads(reads: DataFrame, bad: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, contaminated) reads."""
    return reads.join(bad, list(keys), "left_anti"), reads.join(bad, list(keys), "left_semi")


def matched_in_frame(protein: DataFrame, letters: Column, kmers: DataFrame, keys: Sequence[str], n: int, max_n: int | None = None) -> DataFrame:
    """(keys..., tax, matched): letters of the translated reads that lie in k-mers of each taxon.

    At each place the longest of the pieces of ``n`` to ``max_n`` letters that a
    taxon has counts. Every piece of the frame is joined by equality; no pair of
    read and k-mer is formed that does not match. Longer pieces are made only
    where the n-letter piece matches.
    """
    max_n = max_n or n
    at = protein.select(*keys, letters.alias("s")).where(F.length("s") >= n)
    at = at.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - n + 1), lambda i: F.struct(i.alias("i"), F.substring("s", i, F.lit(max_n)).alias("t")))).alias("e")).select(*keys, "e.*")
    at = at.withColumn("piece", F.substring("t", 1, n))
    stored = kmers.select(F.substring("kmer", 1, max_n).alias("stored"), "tax").distinct()
    if max_n == n:
        hit = at.hint("merge").join(stored.withColumnRenamed("stored", "piece"), "piece")
        return hit.groupBy(*keys, "tax").agg((F.count(F.lit(1)) * n).alias("matched"))
    at = at.join(stored.select(F.substring("stored", 1, n).alias("piece")).distinct(), "piece", "left_semi")
    every = lambda c: F.explode(F.transform(F.sequence(F.lit(n), F.length(c)), lambda k: F.substring(c, F.lit(1), k))).alias("piece")
    hit = at.select(*keys, "i", every("t")).hint("merge").join(stored.select(every("stored"), "tax").distinct(), "piece")
    longest = hit.groupBy(*keys, "i", "tax").agg(F.max(F.length("piece")).alias("len"))
    return longest.groupBy(*keys, "tax").agg(F.sum("len").cast("long").alias("matched"))


def spaced(code: Column, mask: str, h: int = H64) -> Column:
    """The code with the letters of the mask's zeros taken out, so that masked positions compare equal."""
    keep = sum(31 << (5 * (h - 1 - i)) for i, c in enumerate(mask.ljust(h, "1")[:h]) if c == "1")
    return code.bitwiseAND(F.lit(keep).cast("long"))
