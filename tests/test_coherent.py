"""Coherence of whole records: as match by match, and windows that match few letters stay in their record."""

import random

import pytest
from pyspark.sql import functions as F
from test_long_scores import moved

from merloom.functions.codec import clean_dna
from merloom.operators import identify, windows
from merloom.operators.coherent import coherence_of
from merloom.plans import identification


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Tables of few long reads, one longer than a tile, and an index of some of their windows, cut off or changed at all lengths."""
    r, d = random.Random(11), str(tmp_path_factory.mktemp("made"))
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    seqs = [dna(1500) for _ in range(30)] + [dna(700) + "N" * 5 + "AAC" * 150, "A" * 300, "ACGTN" * 3, "", "AC", dna(60_000) + "AAC" * 20_000]
    rows = [(i // 2, 1 + i % 2 if i < 20 else None, 0, f"r{i}", s, None, "dna", 1, "f", None) for i, s in enumerate(seqs)]
    chunks = spark.createDataFrame(rows, "read_id long, mate int, chunk_no int, name string, seq string, qual string, kind string, n_lines int, file string, read_at timestamp")
    chunks = chunks.withColumn("read_id", F.when(F.col("mate").isNull(), F.substring("name", 2, 9).cast("long") + 1000).otherwise(F.col("read_id")))
    chunks.write.parquet(f"{d}/read_chunks.parquet")
    codes = [x.code for x in windows.kmer_windows(chunks, clean_dna(F.col("seq")), ["read_id"], frames=6, min_k=5).where("pos % 40 < 3").select("code").distinct().orderBy("code").limit(4000).collect()]
    pad = sum(30 << 5 * i for i in range(12))
    pairs = []
    for i, c in enumerate(r.sample(codes, 900)):
        low = (1 << 5 * (i % 8)) - 1  # letters that are cut off or others
        pairs.append((None, c & ~low | (pad & low if i % 3 else r.getrandbits(40) & low), i % 7))
    spark.createDataFrame([*pairs, (None, -5, 3), ("KKKKKKKKKKKK", None, 3), ("NNNNNNN^^^^^", None, 4), ("K_______^^^^", None, 5)], "kmer string, code long, tax long").write.parquet(f"{d}/idx_pairs.parquet")
    return d


@pytest.mark.parametrize("lo, hi", [(5, 12), (7, 12), (6, 6), (12, 12)])
def test_same_as_match_by_match(spark, made, lo, hi):
    recs, idx, keys = identification._records(spark, made), identification._idx(spark, made), ["read_id", "mate"]
    want = identify.coherence(identify.longest_matches(identification._windows(spark, made, 6, lo=lo), idx, keys, lo, hi), keys)
    got = coherence_of(recs, clean_dna(F.col("seq")), idx, keys, lo, hi)
    rows = lambda x: sorted((r.read_id, r.mate or 0, round(r.coherence, 6)) for r in x.collect())
    assert rows(got) == rows(want) and any(c > 1 for *_, c in rows(got))


def test_windows_stay_in_their_record(spark, made):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        n = identification._windows(spark, made, 6).count()
        assert n > 200_000 and moved(spark, lambda: identification.QUERIES["coherence"](spark, made)) < 4 * n
    finally:
        for n in names:
            spark.conf.unset(n)
