"""Seen keys, frequent keys and distinct counts against brute force, with a hot key and nulls."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from merloom.llm import heavy, membership, seen

COLS = "pair_id long, key long, tax long, day int, shard int, seen string"


def rows(n=6000, seed=1):
    """A third of the rows has one key; nulls everywhere; ids in no order, repeated rows and ties."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = None if r.random() < 0.02 else 42 if r.random() < 0.34 else r.randrange(2000) * 1_000_003
        out.append((i, key, None if r.random() < 0.1 else r.randrange(30), None if r.random() < 0.02 else r.randrange(14000, 14006), None if r.random() < 0.02 else r.randrange(1, 5), "x"))
    out += out[:20]
    out += [(None, 42, 1, 14000, 1, "x"), (None, 999_999_999_999, 1, 14000, 1, "x"), (None, None, None, None, None, None)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), COLS).repartition(7).cache()


@pytest.mark.parametrize("capacity,chunk", [(1 << 15, 1 << 19), (16, 200)])
def test_seen_before(spark, table, monkeypatch, capacity, chunk):
    monkeypatch.setattr(seen, "CHUNK_ROWS", chunk)
    base = spark.createDataFrame([(5 * 1_000_003,), (None,), (7,), (7,)], "key long")
    out = seen.seen_before(table, F.col("pair_id"), F.col("key"), base, F.col("key"), capacity=capacity, bound=0.05)
    last = 2**63 - 1
    first: dict = {}
    for p, k, *_ in rows():
        if k is not None:
            first[k] = min(first.get(k, last), last if p is None else p)
    for k in (5 * 1_000_003, 7):
        first[k] = -1
    want = Counter((p, k, k is not None and (last if p is None else p) > first[k]) for p, k, *_ in rows())
    got = out.collect()
    assert Counter((x.id, x.key, x.seen) for x in got) == want
    # the chain never calls a seen key new
    late = Counter(x.id for x in got if x.seen and not x.said_seen)
    assert not late
    rep = seen.error_report(out).first()
    assert rep.n_rows == len(rows()) and rep.n_wrong_new == 0 and rep.error_bound <= 0.05 + 1e-12
    assert rep.n_said_seen == rep.n_seen + rep.n_wrong_seen


def test_chain_error_stays_under_its_bound_while_it_grows():
    chain = seen.BloomChain(capacity=64, bound=0.02)
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 2**60, 60_000))
    for at in range(0, len(keys), 1000):
        chain.add(keys[at : at + 1000])
    assert chain.contains(keys).all() and len(chain.layers) > 8
    other = np.setdiff1d(r.integers(0, 2**60, 50_000), keys)
    assert chain.contains(other).mean() < chain.compounded_bound() * 1.2 < 0.024
    for layer in chain.layers[:-1]:
        fill = np.unpackbits(layer.bits).sum() / layer.m
        assert 0.4 < fill < 0.55


def test_seen_of_empty_tables(spark):
    df = spark.createDataFrame([], COLS)
    assert seen.seen_before(df, F.col("pair_id"), F.col("key")).count() == 0
    rep = seen.error_report(seen.seen_before(df, F.col("pair_id"), F.col("key"), df, F.col("key"))).first()
    assert rep.n_rows == 0 and rep.wrong_rate is None


def test_summaries_keep_their_bounds():
    r = np.random.default_rng(5)
    total, true = None, Counter()
    for _ in range(40):
        xs = np.concatenate([r.zipf(1.3, 3000) % 5000, r.integers(10**6, 10**7, 1000)]).astype(np.int64)
        true.update(xs.tolist())
        s = heavy.Summary.exact(xs, len(xs))
        total = s.cut(300) if total is None else total.merge(s, 300)
    assert total.n == sum(true.values()) and len(total.keys) == 300
    for k, c, e in zip(total.keys.tolist(), total.count.tolist(), total.err.tolist()):
        assert c - e <= true[k] <= c
    kept = set(total.keys.tolist())
    assert max(n for k, n in true.items() if k not in kept) <= total.least <= total.n / 300 * 2


@pytest.mark.parametrize("m,chunk", [(2048, 1 << 19), (60, 100)])
def test_frequent_items(spark, table, monkeypatch, m, chunk):
    monkeypatch.setattr(heavy, "CHUNK_ROWS", chunk)
    n = Counter(k for _, k, *_ in rows())
    some = spark.createDataFrame(rows() + [(1, 77, 1, 1, 1, "y")] * 400, COLS).repartition(9)
    n[77] += 400
    for num, den in ((2, 100), (50, 1000)):
        want = {k: c for k, c in n.items() if k is not None and c * den >= num * sum(n.values())}
        got = {x.key: x for x in heavy.frequent_items(some, F.col("key"), num, den, m=m, fan_in=2, levels=3).collect()}
        assert {k: x.rows for k, x in got.items()} == want and len(want) >= 2
        assert all(x["count"] - x["err"] <= x.rows <= x["count"] for x in got.values())


def test_frequent_items_of_empty_and_null_tables(spark):
    assert heavy.frequent_items(spark.createDataFrame([], COLS), F.col("key"), 1, 100).count() == 0
    nulls = spark.createDataFrame([(1, None, 1, 1, 1, "x")] * 5, COLS)
    assert heavy.frequent_items(nulls, F.col("key"), 1, 100).count() == 0
    assert heavy.summary(nulls, F.col("key")).first().n == 5
    with pytest.raises(ValueError):
        heavy.frequent_items(nulls, F.col("key"), 1, 1000, m=100)


def test_membership_patterns(spark, table):
    cell = membership.cell_code(F.col("day"), F.col("shard"))
    pats = membership.patterns(table, F.col("key"), cell)
    sets = defaultdict(set)
    for _, k, _, d, s, _ in rows():
        if k is not None:
            sets[k].add((d, s))
    assert pats.agg(F.sum("n")).first()[0] == len(sets)
    want: Counter = Counter()
    for cells in sets.values():
        groups = {(d, s) for d, s in cells if d is not None and s is not None} | {(d, -1) for d, _ in cells if d is not None} | {(-1, s) for _, s in cells if s is not None}
        want.update(groups)
    got = {(x.d, x.s): x.n_distinct for x in membership.distinct_by_cube(pats).select(membership.cell_day(F.col("grp")).alias("d"), membership.cell_shard(F.col("grp")).alias("s"), "n_distinct").collect()}
    assert got == dict(want)
    code = lambda d, s: membership.cell_code(F.lit(d), F.lit(s))
    a, b = [(14000, 1), (14001, 2)], [(14002, 3)]
    assert membership.count_any(pats, F.array(*[code(*x) for x in a + b])).first().n == sum(1 for c in sets.values() if c & set(a + b))
    assert membership.count_all(pats, [F.array(*[code(*x) for x in a]), F.array(code(*b[0]))]).first().n == sum(1 for c in sets.values() if c & set(a) and c & set(b))
    halves = [membership.patterns(table.where(F.pmod("key", F.lit(2)) == i), F.col("key"), cell) for i in (0, 1)]
    both = membership.merge_patterns(*halves)
    assert {(tuple(x.pattern), x.n) for x in both.collect()} == {(tuple(x.pattern), x.n) for x in pats.collect()}


def test_rows_by_cube_and_empty(spark, table):
    cell = membership.cell_code(F.col("day"), F.col("shard"))
    got = {(x.d, x.s): (x.n_rows, x.n_ident) for x in membership.rows_by_cube(table, cell, F.col("key")).select(membership.cell_day(F.col("grp")).alias("d"), membership.cell_shard(F.col("grp")).alias("s"), "n_rows", "n_ident").collect()}
    n, f = Counter(), Counter()
    for _, k, _, d, s, _ in rows():
        for g in ([(d, s)] if d is not None and s is not None else []) + ([(d, -1)] if d is not None else []) + ([(-1, s)] if s is not None else []):
            n[g] += 1
            f[g] += k is not None
    assert got == {g: (n[g], f[g]) for g in n}
    assert membership.patterns(spark.createDataFrame([], COLS), F.col("key"), cell).count() == 0
