"""DNA from the letters of its codons at every offset.

The codons that may stand at an offset are those of its letter; neighbours
must agree in two bases. Sets of codons (64-bit masks) are narrowed from the
left and from the right; a base is known where all codons left agree on it,
else it is N.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from merloom.functions.codec import codon_table

_B = "ACGT"


@lru_cache(maxsize=8)
def _tables(items: tuple) -> tuple[dict[str, int], list[int], list[int], list[list[int]]]:
    """Mask of the codons of each letter, of those that may follow or precede each codon, and of those with a base at a place."""
    table = dict(items)
    codons = [a + b + c for a in _B for b in _B for c in _B]
    of: dict[str, int] = {}
    for i, c in enumerate(codons):
        of[table[c]] = of.get(table[c], 0) | 1 << i
    after = [sum(1 << j for j, d in enumerate(codons) if d[:2] == c[1:]) for c in codons]
    before = [sum(1 << j for j, d in enumerate(codons) if d[1:] == c[:2]) for c in codons]
    blocks = [[sum(1 << j for j in range(64) if (j // 4 ** (2 - p)) % 4 == b) for b in range(4)] for p in range(3)]
    return of, after, before, blocks


def _spread(mask: int, to: list[int]) -> int:
    out = 0
    while mask:
        low = mask & -mask
        out |= to[low.bit_length() - 1]
        mask ^= low
    return out


def bases(letters: str, table: dict[str, str] | None = None) -> str:
    """The sequence of one more than two bases for the letters; unknown letters allow every codon."""
    of, after, before, blocks = _tables(tuple(sorted((table or codon_table()).items())))
    every = (1 << 64) - 1
    sets = [of.get(x, every) for x in letters]
    for i in range(1, len(sets)):
        sets[i] &= _spread(sets[i - 1], after)
    for i in range(len(sets) - 2, -1, -1):
        sets[i] &= _spread(sets[i + 1], before)

    def base(mask: int, place: int) -> str:
        may = [b for b in range(4) if mask & blocks[place][b]]
        return _B[may[0]] if len(may) == 1 else "N"

    if not sets:
        return ""
    return "".join(base(m, 0) for m in sets) + base(sets[-1], 1) + base(sets[-1], 2)


def reconstructed(letters: Column, table: dict[str, str] | None = None) -> Column:
    """The column form; null and empty texts give an empty sequence."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: bases(x, table) if x else "")

    return run(letters)
