"""Letter, codon and k-mer codecs as Spark column expressions.

A k-mer letter is coded as ``ascii & 31`` and packed big-endian, five bits a
letter, so the order of codes is the order of the upper-case strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

H64 = 12
H128 = 25
PAD = "^"

# Base letters in the order of their codes, and for each base
# triple the amino acid of the standard genetic code; the stop codons TAA and
# TAG are written [ and TGA is written ].
BASES = "TCAG"
STANDARD_CODE = "FFLLSSSSYY[[CC]WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table(amino: str = STANDARD_CODE, base1: str | None = None, base2: str | None = None, base3: str | None = None) -> dict[str, str]:
    """Triple -> letter. The three base rows default to the TCAG order of the standard table."""
    if base1 is None or base2 is None or base3 is None:
        triples = [a + b + c for a in BASES for b in BASES for c in BASES]
    else:
        triples = [a + b + c for a, b, c in zip(base1, base2, base3)]
    return dict(zip(triples, amino.replace("*", "[")))


def clean_dna(seq: Column) -> Column:
    """Upper case; every letter that is no A, C, G or T becomes Z."""
    return F.upper(F.regexp_replace(seq, "[^ACGTacgt]", "Z"))


def clean_protein(seq: Column) -> Column:
    """Upper case; the stop sign ``*`` becomes ``[``."""
    return F.upper(F.translate(seq, "*", "["))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCATGCA"))


def codon_letter(triple: Column, table: dict[str, str] | None = None) -> Column:
    """One letter for three bases. A Z anywhere gives ``_``, else an X anywhere ``^``."""
    names = "ACGTXZ"
    table = table or codon_table()
    letters = "".join("_" if "Z" in a + b + c else table.get(a + b + c, PAD) for a in names for b in names for c in names)
    at = F.lit(1)
    for i, size in ((1, 36), (2, 6), (3, 1)):
        at = at + (F.instr(F.lit(names), F.substring(triple, i, 1)) - 1) * size
    return F.substring(F.lit(letters), at, F.lit(1))


def encode_kmer(kmer: Column, h: int = H64) -> Column:
    """Packed code of an ``h``-letter string (h <= 12); shorter strings are padded with ``^``."""
    s = F.rpad(kmer, h, PAD)
    out = None
    for i in range(h):
        term = F.shiftleft(F.ascii(F.substring(s, i + 1, 1)).cast("long").bitwiseAND(F.lit(31).cast("long")), 5 * (h - 1 - i))
        out = term if out is None else out.bitwiseOR(term)
    return out


def decode_kmer(code: Column, h: int = H64) -> Column:
    """The upper-case letters of a packed code."""
    return F.concat(*[F.char(F.shiftright(code, 5 * (h - 1 - i)).bitwiseAND(F.lit(31).cast("long")).bitwiseOR(F.lit(64).cast("long"))) for i in range(h)])


def kmer_prefix_code(code: Column, k: int, h: int = H64) -> Column:
    """Code of the first ``k`` letters."""
    return F.shiftright(code, 5 * (h - k))


def code_prefix(code: Column, k: int, h: int = H64) -> Column:
    """The first ``k`` letters of an index key: a packed code up to 12 letters, text beyond."""
    return kmer_prefix_code(code, k, h) if h <= H64 else F.substring(code, 1, k)


def pads_at(code: Column, k: int, h: int = H64) -> Column:
    """Whether the k-th letter of an index key is padding."""
    if h > H64:
        return F.substring(code, k, 1) == PAD
    return F.shiftright(code, 5 * (h - k)).bitwiseAND(F.lit(31).cast("long")) == (ord(PAD) & 31)


def pair_key(kmer: str = "kmer", code: str = "code") -> Column:
    """The key of an index pair as a packed code: ``code`` where filled, else the letters of ``kmer``; null if both are null."""
    return F.coalesce(F.col(code), encode_kmer(F.col(kmer)))
