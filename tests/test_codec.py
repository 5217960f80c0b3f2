import itertools
import random

from pyspark.sql import functions as F

from merloom.functions import codec, scoring, text
from merloom.operators import windows


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], ",".join(f"{k} string" for k in cols))


def test_codon_table_is_the_standard_code_with_two_stop_letters():
    t = codec.codon_table()
    assert len(t) == 64 and t["ATG"] == "M" and t["TGG"] == "W"
    assert t["TAA"] == t["TAG"] == "[" and t["TGA"] == "]"
    assert len(set(t.values())) == 22


def test_unknown_and_padding_letters(spark):
    rows = spark.createDataFrame([(x,) for x in ("AXZ", "AXG", "ZZZ", "ATG", "XXX")], "t string")
    got = dict(rows.select("t", codec.codon_letter(F.col("t"))).collect())
    assert got == {"AXZ": "_", "AXG": "^", "ZZZ": "_", "ATG": "M", "XXX": "^"}


def test_encode_decode_round_trip_and_order(spark):
    r = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^"
    ks = sorted({"".join(r.choice(letters) for _ in range(12)) for _ in range(300)})
    df = spark.createDataFrame([(k,) for k in ks], "k string").select("k", codec.encode_kmer(F.col("k")).alias("c"))
    rows = df.select("k", "c", codec.decode_kmer(F.col("c")).alias("d")).collect()
    assert all(x.k == x.d for x in rows)
    assert [x.k for x in sorted(rows, key=lambda x: x.c)] == ks
    low = df.select(codec.encode_kmer(F.lower("k")).alias("c")).collect()
    assert sorted(x.c for x in low) == sorted(x.c for x in rows)


def test_short_and_null_kmers(spark):
    df = spark.createDataFrame([("AB",), (None,), ("",)], "k string")
    got = [x[0] for x in df.select(codec.decode_kmer(codec.encode_kmer(F.col("k")))).collect()]
    assert got == ["AB^^^^^^^^^^", None, "^" * 12]


def test_reverse_complement_twice_is_the_same(spark):
    df = one(spark, s="ACGTZZXA")
    assert df.select(codec.reverse_complement(codec.reverse_complement(F.col("s")))).first()[0] == "ACGTZZXA"


def test_accessions(spark):
    cases = [("gi|12|ref|NC_0001.2| some name", "NC_0001.2"), ("ZW_1.1 x", "ZW_1.1"), ("plain header", None), (None, None), ("", None), ("a|b c.d", None)]
    df = spark.createDataFrame([c[:1] for c in cases], "h string")
    assert [x[0] for x in df.select(text.accession_of(F.col("h"))).collect()] == [c[1] for c in cases]


def test_entropy(spark):
    df = spark.createDataFrame([("AAAAAAAAAAAA",), ("ABCDEFGHIJKL",), ("AAAAAABBBBBB",)], "k string")
    got = [x[0] for x in df.select(scoring.entropy(F.col("k"))).collect()]
    import math

    assert abs(got[0]) < 1e-12 and abs(got[1] - math.log(12) / math.log(22)) < 1e-9 and abs(got[2] - math.log(2) / math.log(22)) < 1e-9


def naive_letters(dna, table):
    out = []
    for i in range(len(dna) - 2):
        t = dna[i : i + 3]
        out.append("_" if "Z" in t else table.get(t, "^"))
    return out


def naive_windows(seq, kind, frames, h, side, min_k):
    """Every window by hand."""
    t = codec.codon_table()
    if not seq:
        return []
    if kind == "protein":
        s = seq.upper().replace("*", "[")
        pad = h - 1 if side == "reference" else max(h - min_k, h - len(s))
        s += "^" * pad
        n = len(s) - h + 1 if side == "reference" or len(s) > h + 1 else 0
        return [(0, i, s[i : i + h]) for i in range(n)]
    out = []
    clean = "".join(c if c in "ACGT" else "Z" for c in seq.upper())
    strands = [clean] + ([clean[::-1].translate(str.maketrans("ACGT", "TGCA"))] if frames == 6 else [])
    for k, s in enumerate(strands):
        s += "X" * (3 * (h - 1) if side == "reference" else max(3 * (h - min_k), 3 * h - len(s)))
        ls = naive_letters(s, t)
        step = 3 if frames == 1 else 1
        if side == "read":
            n = (len(s) // 3 - h + 1 if len(s) // 3 > h + 1 else 0) if frames == 1 else (len(s) - 3 * h + 1 if len(s) > 3 * h + 1 else 0)
            pos = [i * step for i in range(n)]
        else:
            pos = [i for i in range(0, len(s) - 3 * h + 1, step)]
        out += [(k, i, "".join(ls[i : i + 3 * h : 3])) for i in pos]
    return out


def test_windows_against_hand_made_ones(spark):
    r = random.Random(5)
    seqs = ["", None, "A", "ACG", "ACGT" * 5, "ACGTNACGT" * 6, "acgtnn" * 8] + ["".join(r.choice("ACGTN") for _ in range(n)) for n in (20, 21, 22, 23, 24, 35, 36, 37, 60, 131)]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, s string").withColumn("d", codec.clean_dna(F.col("s")))
    for frames, side, h in itertools.product((1, 3, 6), ("read", "reference"), (12, 25)):
        w = windows.kmer_windows(df, F.col("d"), ["i"], frames=frames, side=side, h=h, as_text=True)
        got = sorted(tuple(x) for x in w.collect())
        want = sorted((i, *x) for i, s in enumerate(seqs) for x in naive_windows(s, "dna", frames, h, side, 7))
        assert got == want, (frames, side, h)


def test_protein_windows(spark):
    seqs = ["", None, "M", "MKV*LLA", "MKVLAAGGTTRR", "mkvlaaggttrrs", "ABCDEFGHIJKLMNOPQRST*"]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, s string")
    for side in ("read", "reference"):
        w = windows.kmer_windows(df, F.col("s"), ["i"], kind="protein", side=side, as_text=True)
        assert sorted(tuple(x) for x in w.collect()) == sorted((i, *x) for i, s in enumerate(seqs) for x in naive_windows(s, "protein", 3, 12, side, 7))


def test_long_sequence_is_tiled(spark, monkeypatch):
    r = random.Random(3)
    s = "".join(r.choice("ACGT") for _ in range(5000))
    df = spark.createDataFrame([(1, s)], "i int, s string")
    for frames in (1, 3, 6):
        w = windows._Windower("dna", frames, 12, "read", 7, None)
        monkeypatch.setattr(windows, "TILE", 3 * 100)
        parts = [p for p in w.pieces([s])]
        assert len(parts) > 10
        monkeypatch.undo()
        whole = sorted(tuple(x)[1:] for x in windows.kmer_windows(df, F.col("s"), ["i"], frames=frames).collect())
        tiled = []
        for p in parts:
            _, strand, pos, letters, at = w.codes([p])
            tiled += list(zip(strand.tolist(), pos.tolist(), w.packed(letters, at).tolist()))
        assert sorted(tiled) == whole


def test_native_translation_equals_the_batch_one(spark):
    df = spark.createDataFrame([("ACGTNNACGTTTGA",), ("",), (None,), ("AC",)], "s string").select(codec.clean_dna(F.col("s")).alias("d"))
    t = codec.codon_table()
    for x in df.select("d", windows.translate_native(F.col("d")).alias("n"), windows.in_one_frame(F.col("d")).alias("o")).collect():
        if x.d is not None:
            assert x.n == "".join(naive_letters(x.d, t)) and x.o == "".join(naive_letters(x.d, t)[::3])


def test_reconstruction_agrees_where_it_knows():
    from merloom.operators import reconstruct

    r = random.Random(11)
    known = total = 0
    for _ in range(30):
        dna = "".join(r.choice("ACGT") for _ in range(120))
        again = reconstruct.bases("".join(naive_letters(dna, codec.codon_table())))
        assert len(again) == len(dna) and all(a in ("N", b) for a, b in zip(again, dna))
        known += sum(a != "N" for a in again)
        total += len(dna)
    assert known / total > 0.9
    assert reconstruct.bases("") == ""
    # with one letter for each codon everything is known
    own = {c: chr(200 + i) for i, c in enumerate(codec.codon_table())}
    dna = "ACGTTGCATGCCGTA"
    assert reconstruct.bases("".join(own[dna[i : i + 3]] for i in range(len(dna) - 2)), own) == dna


def test_lookup_guards(spark):
    import pytest

    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [x[0] for x in df.select(text.lookup({1: 10}, F.col("k"), F.lit(0))).collect()] == [10, 0, 0]
    with pytest.raises(Exception, match="unknown tax: 2"):
        df.where("k = 2").select(text.lookup({1: 10}, F.col("k"), what="tax")).collect()
