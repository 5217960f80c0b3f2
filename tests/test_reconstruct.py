"""Rebuilt bases against all sequences that give the same letters."""

import itertools
import random

from merloom.functions.codec import codon_table
from merloom.operators import reconstruct


def test_known_bases_are_those_all_sequences_share():
    table = codon_table()
    by: dict = {}
    for bases in itertools.product("ACGT", repeat=7):
        s = "".join(bases)
        by.setdefault("".join(table[s[i : i + 3]] for i in range(5)), []).append(s)
    r = random.Random(3)
    some = r.sample(sorted(by), 400)
    unknown = 0
    for letters in some:
        got = reconstruct.bases(letters)
        want = "".join(x[0] if len(set(x)) == 1 else "N" for x in zip(*by[letters]))
        # what is given is true of every sequence; codons are narrowed pair by pair, so no more is known than that
        assert len(got) == 7 and all(g in ("N", w) for g, w in zip(got, want)), (letters, got, want)
        unknown += got != want
    assert unknown <= len(some) * 0.02
