"""Weights and scores of matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merloom.functions.codec import H64


def weight(k: Column | int) -> Column:
    """k squared over 625."""
    k = F.lit(k) if isinstance(k, int) else k
    return k.cast("double") * k / 625.0


def best_score(length: Column, min_k: int, max_k: int, frames: int = 3, kind: str = "dna") -> Column:
    """The score of a perfect match over the whole length; terms below one window count as one."""
    out = F.lit(0.0)
    for k in range(min_k, max_k + 1):
        if kind == "protein":
            n, mult = length - k + 1, 1
        elif frames == 1:
            n, mult = F.floor(length / 3) - k + 1, 1
        else:
            n, mult = length - 3 * k + 1, 2 if frames == 6 else 1
        out = out + mult * F.greatest(n, F.lit(1)).cast("double") * (k * k / 625.0)
    return out


def relative_score(score: Column, freq: Column, length: Column, h: int = H64, kind: str = "dna") -> Column:
    """score / (1 + log2(freq * windows)); windows and frequency count as one at least."""
    n = F.greatest(length - ((3 * h if kind == "dna" else h) - 1), F.lit(1))
    return score / (1.0 + F.log2(F.greatest(freq, F.lit(1)).cast("double") * n))


def error(score: Column, best: Column) -> Column:
    return (best - score) / best


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy(kmer: Column, h: int = H64) -> Column:
    """Letter entropy over ln 22 of an ``h``-letter k-mer; padding counts as a letter.

    The entropy is the mean over positions of -log2(share of the position's
    letter), so it needs one count for each position and no array.
    """

    def of(s: Column) -> Column:
        n = F.length(s)
        out = F.lit(0.0)
        for i in range(1, h + 1):
            c = n - F.length(F.replace(s, F.substring(s, i, 1), F.lit("")))
            out = out - F.when(n >= i, F.log2(c.cast("double") / n) / n).otherwise(0.0)
        return out * F.lit(0.6931471805599453 / 3.091042453358316)

    return let(kmer, of)
