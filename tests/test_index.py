import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from merloom.functions.codec import decode_kmer, encode_kmer
from merloom.operators import identify, index, profile


def make(spark, rows):
    return index.build(spark.createDataFrame(rows, "kmer string, tax long").withColumn("c", encode_kmer(F.col("kmer"))), F.col("c"), F.col("tax"))


def rows_of(idx):
    return sorted((x.k, x.tax) for x in idx.select(decode_kmer(F.col("code")).alias("k"), "tax").collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [("".join(r.choice("AB^") if i > 8 else r.choice("ABC") for i in range(12)), r.randrange(1, 6)) for _ in range(300)]
    return out + out[:50] + [(None, 3), ("ABCABCABCABC", None)]


def clean(rows):
    return sorted({(k, t) for k, t in rows if k is not None and t is not None})


def test_build_update_merge_delete(spark, rows):
    half = len(rows) // 2
    a, b, whole = make(spark, rows[:half]), make(spark, rows[half:]), make(spark, rows)
    assert rows_of(whole) == clean(rows)
    assert rows_of(index.update(a, b)) == rows_of(whole) == rows_of(index.merge(b, a))
    assert rows_of(index.merge(whole, whole)) == rows_of(whole)
    remap = spark.createDataFrame([(1, 91)], "old long, new long")
    assert rows_of(index.merge(a, b, remap, remap)) == sorted({(k, 91 if t == 1 else t) for k, t in clean(rows)})
    gone = spark.createDataFrame([(2,), (None,), (2,)], "tax long")
    assert rows_of(index.delete(whole, gone)) == [x for x in clean(rows) if x[1] != 2]
    empty = make(spark, [])
    assert rows_of(index.merge(empty, a)) == rows_of(a) and rows_of(empty) == []


def test_statistics(spark, rows):
    idx, c = make(spark, rows), clean(rows)
    freq = {(x.tax, x.k): x.n for x in index.frequencies(idx).collect()}
    for t in {t for _, t in c}:
        for k in range(1, 13):
            assert freq[(t, k)] == sum(1 for km, u in c if u == t and km[k - 1] != "^")
    d = sorted((x.start, x.cnt) for x in index.directory(idx).collect())
    starts = Counter(k[:6] for k, _ in c)
    assert [n for _, n in d] == [starts[p] for p in sorted(starts)]
    assert [s for s, _ in d] == [sum(starts[q] for q in starts if q < p) for p in sorted(starts)]
    per = Counter(k for k, _ in c)
    h = {x.n_taxa: x.n_kmers for x in index.redundancy(idx).collect()}
    assert h == dict(Counter(per.values()))
    assert {x.n_taxa for x in index.frequent_kmers(idx, 2).collect()} <= {n for n in per.values() if n >= 2}
    csr = sorted((x.start, tuple(x.taxa)) for x in index.csr(idx).collect())
    flat = [t for _, ts in csr for t in ts]
    assert flat == [t for _, t in c]


def test_shrinking(spark, rows):
    idx, c = make(spark, rows), clean(rows)
    for g in (10, 25, 50, 80):
        kept = rows_of(index.shrink_every_nth(idx, g))
        for t in {t for _, t in c}:
            mine = [k for k, u in c if u == t]
            drop, nxt = set(), 100 / g
            for i in range(1, len(mine) + 1):
                if i == int(nxt):
                    drop.add(i)
                    nxt += 100 / g
            assert [k for k, u in kept if u == t] == [k for i, k in enumerate(mine, 1) if i not in drop]
    over = {k for k, n in Counter(k for k, _ in c).items() if n <= 2}
    assert rows_of(index.shrink_overrepresented(idx, 2)) == [x for x in c if x[0] in over]
    assert index.shrink_halve(idx).count() == sum(1 for k, _ in c if k[6:] != "^" * 6)


def naive_identify(reads, idx, min_k, max_k):
    """The scoring formula, word for word."""
    score, alls, uniq, total = defaultdict(float), defaultdict(float), Counter(), Counter()
    for k in range(min_k, max_k + 1):
        taxa = defaultdict(set)
        for km, t in idx:
            if km[k - 1] != "^":
                taxa[km[:k]].add(t)
        seen = set()
        for rid, km in reads:
            p = km[:k]
            if km[k - 1] == "^" or p not in taxa:
                continue
            ts = taxa[p]
            for t in ts:
                score[(rid, t)] += k * k / 625 / len(ts)
                alls[(t, k)] += 1 / len(ts)
                uniq[(t, k)] += len(ts) == 1
                if p not in seen:
                    total[(t, k)] += 1
            seen.add(p)
    return score, alls, uniq, total


def test_identify_against_the_formula(spark, rows):
    r = random.Random(8)
    c = clean(rows)
    reads = [(i % 9, r.choice(c)[0] if r.random() < 0.5 else "".join(r.choice("ABC^") for _ in range(12))) for i in range(200)] + [(1, c[0][0])] * 70
    w = spark.createDataFrame(reads, "read_id int, kmer string").select("read_id", encode_kmer(F.col("kmer")).alias("code"))
    idx = make(spark, rows)
    for lo, hi in ((3, 12), (7, 12), (5, 5)):
        score, alls, uniq, total = naive_identify(reads, c, lo, hi)
        got = identify.read_scores(identify.match(w, idx, ["read_id"], lo, hi), ["read_id"])
        assert {(x.read_id, x.tax): round(x.score, 9) for x in got.collect()} == {k: round(v, 9) for k, v in score.items()}
        counts = identify.taxon_counts(w, idx, lo, hi).collect()
        assert {(x.tax, x.k): round(x.count_all, 9) for x in counts} == {k: round(v, 9) for k, v in alls.items()}
        assert all(x.count_unique == uniq[(x.tax, x.k)] and x.count_total == total[(x.tax, x.k)] for x in counts)


def test_hit_ranking_rules(spark):
    rated = spark.createDataFrame(
        [(1, 100, t, float(s), float(r), 0.1) for t, s, r in ((5, 9, 1.0), (3, 8, 0.9), (2, 7, 0.85), (9, 7, 0.5), (8, 7, 0.4), (7, 6, 0.3))] + [(2, 100, 1, 4.0, 0.5, 0.1), (2, 100, 2, 4.0, 0.1, 0.1), (2, 100, 3, 4.0, 0.05, 0.1), (2, 100, 4, 1.0, 0.01, 0.1)],
        "read_id int, seq_len int, tax long, score double, relative double, error double",
    )
    got = defaultdict(list)
    for x in identify.rank_hits(rated, ["read_id"], 3).orderBy("read_id", "rank").collect():
        got[x.read_id].append((x.tax, x.hit))
    assert got[1] == [(5, "top"), (3, "top"), (2, "top")]
    # one top hit; the first further row is a change, its ties are none; the next change is the last allowed
    assert got[2] == [(1, "top"), (2, "further"), (3, "further"), (4, "further")]


def test_coherence(spark):
    m = spark.createDataFrame([(1, 0, 0, 7), (1, 0, 3, 7), (1, 0, 6, 7), (1, 0, 40, 9), (1, 1, 5, 12), (2, 0, 1, 7)], "read_id int, strand int, pos int, len int")
    got = {x.read_id: x.coherence for x in identify.coherence(m, ["read_id"]).collect()}
    assert got == {1: 4 + 1 - 1 / 2, 2: 0.0}


def test_profile_shares(spark):
    counts = spark.createDataFrame([(1, 7, 2.0, 2, 1), (2, 7, 6.0, 0, 2)], "tax long, k int, count_all double, count_unique long, count_total long")
    n = spark.createDataFrame([(20,)], "n long")
    total = profile.input_size(n, spark.createDataFrame([(0,)], "n long"), 7, 7)
    rel = profile.relative(counts, total)
    got = {x.tax: (x.unique_rel, x.all_rel, x.overall_rel) for x in rel.collect()}
    assert got == {1: (1.0, 0.25, 0.1), 2: (0.0, 0.75, 0.3)}
    assert profile.not_identified(rel, total).first().overall_rel == pytest.approx(0.6)
