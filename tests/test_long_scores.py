"""Long matches by runs of windows: the same scores as window by window, and far less moved."""

import random

from pyspark.sql import functions as F

from merloom.functions.codec import H128, clean_dna
from merloom.operators import identify, index, windows
from merloom.operators.long_scores import long_scores
from merloom.plans import identification


def moved(spark, df) -> int:
    """Bytes that a run of ``df`` writes to shuffles and to the shared folder."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))

    before = total()
    df().collect()
    return total() - before


def rows(n: int):
    """Reads that are references, near copies of them, or neither; foreign letters, short ones, long repeats."""
    r = random.Random(5)
    dna = lambda k: "".join(r.choice("ACGT") for _ in range(k))
    out, seqs = [], [dna(r.choice((39, 40, 41, 42, 75, 90, 200))) for _ in range(n)] + ["AAC" * 120, "ACGT" * 60, "", None, dna(60) + "N" + dna(90), "A" * 400]
    for i, s in enumerate(seqs):
        out.append((i % 17 if i % 17 else None, 7 + i % 5 if i % 3 else None, s, i % 4 != 0))
        if s and len(s) > 60:
            at = r.randrange(len(s))
            out.append((100 + i, 2**32 + i % 3 if i % 2 else None, s[:at] + r.choice("ACGTN") + s[at + 1 :], True))
    return out


def test_same_as_window_by_window(spark):
    df = spark.createDataFrame(rows(60), "read_id long, tax long, seq string, is_read boolean").repartition(3)
    for lo, hi in ((13, 25), (15, 20), (25, 25)):
        q = windows.kmer_windows(df.where("is_read"), clean_dna(F.col("seq")), ["read_id"], h=H128, min_k=lo).withColumnRenamed("kmer", "code")
        w = windows.drop_unknown(windows.kmer_windows(df.where("tax is not null"), clean_dna(F.col("seq")), ["tax"], h=H128, side="reference"), H128)
        want = identify.read_scores(identify.match(q, index.build(w, F.col("kmer"), F.col("tax")), ["read_id"], lo, hi, H128), ["read_id"])
        as_rows = lambda x: {(r.read_id, r.tax): (round(r.score, 6), r.hits) for r in x.collect()}
        got = as_rows(long_scores(df, clean_dna(F.col("seq")), "read_id", "tax", lo, hi))
        assert got == as_rows(want) and len(got) > 50


def test_a_window_is_not_moved_by_itself(spark, data):
    letters = spark.read.parquet(f"{data}/read_chunks.parquet").agg(F.sum(F.length("seq"))).first()[0]
    assert moved(spark, lambda: identification.QUERIES["identify_long"](spark, data)) < 25 * letters
