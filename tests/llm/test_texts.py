"""Splitting, packing, mixing and languages against brute force, round trips and held-out data."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from merloom.llm import gru, language, mixing, packing, splitting, tokens
from merloom.llm.queries import QUERIES

CHUNKS = "file string, read_id long, mate int, chunk_no int, name string, seq string, qual string, kind string, read_at long, f string, pieces int"


def plain(t):
    return re.sub(r"[\r\n\t ]", "", t)


def boundaries(text, kind):
    """By hand: line breaks, N runs, stops."""
    out, n = set(), 0
    for c in text:
        if c in "\r\n":
            out.add(n)
        elif c not in "\t ":
            n += 1
    p = plain(text)
    if kind == "protein":
        out |= {i + 1 for i, c in enumerate(p) if c == "*"}
    else:
        for m in re.finditer(r"[Nn]{5,}", p):
            out |= {m.start(), m.end()}
    return sorted(x for x in out if 0 < x < n), n


def natural(points, n, limit, overlap):
    """Exhaustive reachability."""
    reach = {p for p in points if p <= limit and p >= overlap}
    grown = True
    while grown:
        more = {q for p in reach for q in points if p < q <= p + limit - overlap} - reach
        reach |= more
        grown = bool(more)
    return any(n - p <= limit - overlap for p in reach)


def random_record(r):
    kind = r.choice(["dna", "protein"])
    n, out = r.randrange(0, 400), []
    while len(out) < n:
        x = r.random()
        out.append("\r\n" if x < 0.02 else "\n" if x < 0.04 else " " if x < 0.05 else "N" * r.randrange(1, 12) if x < 0.07 and kind == "dna" else "*" if x < 0.08 else r.choice("ACGT"))
    return kind, "".join(out)


def test_boundaries_and_cuts_against_brute_force():
    r = random.Random(1)
    limit, overlap, both = 60, 7, set()
    for _ in range(400):
        kind, text = random_record(r)
        at = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(0, 4)))
        parts = [text[a:b] for a, b in itertools.pairwise([0, *at, len(text)])]
        fs = [dict(zip(("n", "brk", "run_start", "run_end", "stops"), splitting.chunk_features(p, kind))) for p in parts]
        total, points = splitting.record_boundaries([{"f": f} for f in fs], kind)
        want, n = boundaries(text, kind)
        assert total == n and points.tolist() == want
        if n > limit:
            cuts, ok = splitting.best_cuts(n, points, limit, overlap)
            assert ok == natural(want, n, limit, overlap)
            both.add(ok)
            pieces = splitting.pieces_of(n, cuts, overlap)
            assert all(e - s <= limit for s, e in pieces) and pieces[0][0] == 0 and pieces[-1][1] == n
            assert all(b[0] == a[1] - overlap >= 0 for a, b in itertools.pairwise(pieces))
            if ok:
                assert set(cuts) <= set(want)
            else:
                # no cutting has fewer forced cuts than the number of gaps asks for
                edges = [0, *[x for x in want if x >= overlap], n]
                least = sum(max(0, -(-(b - a) // (limit - overlap)) - 1) for a, b in itertools.pairwise(edges) if b - a > (limit if a == 0 else limit - overlap))
                assert sum(c not in want for c in cuts) <= least
    assert both == {True, False}


def test_cuts_are_the_best():
    """All cuttings of small records, by brute force."""
    r = random.Random(4)
    limit, overlap = 10, 2
    for _ in range(60):
        n = r.randrange(11, 30)
        points = sorted(r.sample(range(1, n), r.randrange(3, n - 1)))
        if not natural(points, n, limit, overlap):
            continue
        usable = [p for p in points if p >= overlap]
        want = None
        for k in range(1, 6):
            for cuts in itertools.combinations(usable, k):
                ps = splitting.pieces_of(n, list(cuts), overlap)
                if all(e - s <= limit for s, e in ps):
                    size = (n + (max(2, -(-(n - overlap) // (limit - overlap))) - 1) * overlap) / max(2, -(-(n - overlap) // (limit - overlap)))
                    c = sum(((e - s - size) / limit) ** 2 for s, e in ps)
                    want = c if want is None else min(want, c)
        cuts, ok = splitting.best_cuts(n, np.array(points), limit, overlap)
        size = (n + (max(2, -(-(n - overlap) // (limit - overlap))) - 1) * overlap) / max(2, -(-(n - overlap) // (limit - overlap)))
        got = sum(((e - s - size) / limit) ** 2 for s, e in splitting.pieces_of(n, cuts, overlap))
        assert ok and abs(got - want) < 1e-9


def test_split_records_round_trip(spark):
    r = random.Random(7)
    rows, texts = [], {}
    for i in range(60):
        kind, text = random_record(r)
        text = text * r.choice([1, 1, 5])
        if i == 0:
            text = ("ACGT" * 15 + "\n") * 400  # a third of all rows in one record
        n = 90 if i == 0 else r.randrange(1, 4)
        at = sorted(r.randrange(len(text) + 1) for _ in range(n - 1))
        mate = None if r.random() < 0.7 else r.choice([1, 2])
        texts[(i, mate)] = (kind, text)
        for j, (a, b) in enumerate(itertools.pairwise([0, *at, len(text)])):
            rows += [("f", i, mate, j, "x", text[a:b], None, kind, 1, "clash", 3)] * (3 if r.random() < 0.1 else 1)
    rows += [("f", 900, None, 0, None, None, None, None, None, None, None), ("f", 901, None, None, None, "A" * 70 + "\n" + "C" * 20, None, None, 1, None, None)]
    texts[(901, None)] = ("dna", "A" * 70 + "\n" + "C" * 20)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, CHUNKS).repartition(5)
    s = splitting.split_records(df, 60, {"dna": 7, "protein": 3})
    got = {(x.read_id, x.mate): x for x in s.collect()}
    assert set(got) == {k for k, (_, t) in texts.items() if len(plain(t)) > 60}
    for k, x in got.items():
        kind, t = texts[k]
        want, n = boundaries(t, kind)
        assert x.n_letters == n and x.cut == ("natural" if natural(want, n, 60, 7 if kind == "dna" else 3) else "forced")
    whole = defaultdict(dict)
    for p in splitting.piece_texts(df, s).collect():
        whole[(p.read_id, p.mate)][p.piece_no] = p.text
    for k, x in got.items():
        ps, over = whole[k], 7 if x.kind == "dna" else 3
        assert all(len(t) <= 60 for t in ps.values()) and len(ps) == len(x.pieces)
        assert ps[0] + "".join(ps[i][over:] for i in range(1, len(ps))) == plain(texts[k][1])
        assert all(ps[i].startswith(ps[i - 1][-over:]) for i in range(1, len(ps)))
    assert splitting.split_records(spark.createDataFrame([], CHUNKS)).count() == 0


def test_overlap_must_be_less_than_the_limit():
    with pytest.raises(ValueError):
        splitting.best_cuts(100, np.array([50]), 10, 10)


def test_fill_is_the_best_subset():
    r = random.Random(2)
    for _ in range(200):
        items = [r.randrange(1, 30) for _ in range(r.randrange(1, 10))]
        room = r.randrange(1, 60)
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        used = packing.fill_one(sorted(counts, reverse=True), dict(counts), room)
        assert all(c <= counts[n] for n, c in used.items())
        best = max(sum(s) for k in range(len(items) + 1) for s in itertools.combinations(items, k) if sum(s) <= room)
        assert sum(n * c for n, c in used.items()) == best


def test_packing_keeps_everything(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([0, None, 5, r.randrange(1, 900), r.randrange(1, 100), 1000, 1001, r.randrange(1000, 9000)]), "x") for i in range(3000)]
    sizes += [(None, 10, "x"), (None, 10, "x"), (1, 700, "x"), (1, 700, "x")]
    df = spark.createDataFrame(sizes, "id long, size long, container string").repartition(6)
    out = packing.pack(df, F.col("id"), F.col("size"), capacity=1000, window=200).collect()
    assert sum(x.size for x in out) == sum(n or 0 for _, n, _ in sizes)
    whole = lambda i, n: (i is None, i or 0, n or 0)
    assert sorted(whole(x.id, x.n_tokens) for x in out if x.piece_no == 0) == sorted(whole(i, n) for i, n, _ in sizes)
    room = defaultdict(int)
    for x in out:
        assert (x.container is None) == (x.size == 0) and (x.piece_no == 0 or x.n_tokens > 1000) and x.oversized == (x.n_tokens > 1000)
        if x.container is not None:
            room[x.container] += x.size
    assert max(room.values()) <= 1000
    assert len(room) <= -(-sum(room.values()) // 1000) * 1.02 + 1
    assert packing.pack(df.limit(0), F.col("id"), F.col("size")).count() == 0


def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    e = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello world, it's me.", "été \U0001f600 <|endoftext|>", " " * 50 + "\n" * 20, "a" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {x.i: x.n_tokens for x in tokens.with_tokens(df).collect()}
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_long_texts_count_in_parts():
    r = random.Random(6)
    e = tokens.encoder()
    text = "".join(r.choice(["word ", "été  ", "12 ", "a, ", "\n", "it's ", "  x", "\U0001f600"]) for _ in range(4000))
    ps = tokens.parts(text, 500)
    assert len(ps) > 10 and "".join(ps) == text
    assert sum(len(e.encode_ordinary(p)) for p in ps) == len(e.encode_ordinary(text))
    assert tokens.parts("a" * 5000, 100) == ["a" * 5000]


def test_odd_long_texts():
    e = tokens.encoder()
    t = "one two  three\n" * 700 + " " * 12_000 + "end"
    assert tokens.count_tokens(e, t) == len(e.encode_ordinary(t))
    assert tokens.count_tokens(e, " " * 1_000_000) > 0 and tokens.count_tokens(e, "a" * 1_000_000) > 0 and tokens.count_tokens(e, "\n \t" * 300_000 + "x") > 0
    assert tokens.count_tokens(e, None) == tokens.count_tokens(e, "") == 0


def mix_tables(spark):
    r = random.Random(9)
    docs = []
    for i in range(3000):
        src = "Big " if r.random() < 0.34 else r.choice(["mid", "MID", " small", None, "unlisted"]) if r.random() < 0.9 else "tiny"
        docs.append((i, src, r.choice([0, r.randrange(1, 50), r.randrange(1, 400)]), r.random() + 0.01))
    docs += docs[:5]
    df = spark.createDataFrame(docs, "id long, s string, t long, w double")
    targets = spark.createDataFrame([("big", 0.2, 1), ("Mid", 0.5, 3), ("small", 0.2, 1), ("tiny", 0.05, 9), ("absent", 0.05, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    return docs, mixing.slim(df, F.col("id"), F.col("s"), F.col("t"), F.col("w")), targets


def test_mix_against_brute_force(spark):
    docs, slim, targets = mix_tables(spark)
    plan = mixing.budgets(slim, targets)
    mixed = mixing.mix(slim, plan, seed=3, buckets=64)
    total = sum(t for _, _, t, _ in docs)
    have = defaultdict(int)
    for _, s, t, _ in docs:
        if s:
            have[s.strip().lower()] += t
    rows = {x.source: x for x in plan.collect()}
    rep = {x.source: x for x in mixing.mix_report(plan, mixed).collect()}
    keys = {x.id: x.k for x in slim.withColumn("k", -F.log(mixing._uniform(F.col("id"), 3)) / F.col("weight")).collect()}
    uses = defaultdict(list)
    for x in mixed.collect():
        uses[x.source].append((x.id, x.uses, x.tokens))
    for name, share, most in (("big", 0.2, 1), ("Mid", 0.5, 3), ("small", 0.2, 1), ("tiny", 0.05, 9), ("absent", 0.05, 2)):
        x, size = rows[name], have[name.lower()]
        assert x.available == size and rep[name].short == (size * most < share * total)
        whole = min(int(share * total // size) if size else 0, most)
        assert x.epochs == whole
        rest = share * total - whole * size if whole < most else 0
        mine = sorted(((keys[i], i, t) for i, s, t, _ in docs if s and s.strip().lower() == name.lower()))
        got, run = {}, 0
        for _, i, t in mine:
            run += t
            if run > rest:
                break
            if t:
                got.setdefault(i, 0)
                got[i] += 1
        more = defaultdict(int)
        for i, u, t in uses[name]:
            assert u <= most
            more[i] += u - whole
        assert {i: n for i, n in more.items() if n} == got
    assert sum(x.actual_share for x in rep.values()) == pytest.approx(1.0)
    assert abs(rep["big"].used - 0.2 * total) < 400


def test_weights_steer_the_sample(spark):
    df = spark.range(4000).select("id", F.lit("a").alias("s"), F.lit(10).cast("long").alias("t"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1).alias("w"))
    slim = mixing.slim(df, F.col("id"), F.col("s"), F.col("t"), F.col("w"))
    plan = mixing.budgets(slim, spark.createDataFrame([("a", 0.2, 1)], "source string, target_share double, max_repeats int"))
    got = [x.id for x in mixing.mix(slim, plan).collect()]
    assert abs(len(got) - 800) <= 1 and sum(i % 2 == 0 for i in got) > 650


def test_mix_of_empty_tables(spark):
    e = spark.createDataFrame([], "id long, s string, t long, w double")
    slim = mixing.slim(e, F.col("id"), F.col("s"), F.col("t"), F.col("w"))
    plan = mixing.budgets(slim, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert mixing.mix(slim, plan).count() == 0 and mixing.mix_report(plan, mixing.mix(slim, plan)).first().used == 0


def test_gradients():
    """Backpropagation through time against finite differences."""
    texts = [b"abc abd xyz.", b"q", b"hello there, you all"]
    net = gru.ByteGRU(["a", "b", "c"], 5, 1, gru.pairs_of(texts, 1))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["P"] += np.random.default_rng(0).standard_normal(net.p["P"].shape) * 0.1
    net.p["P"][0] = 0
    x, steps = gru.to_blocks(texts)
    y = np.array([0, 2, 1])
    _, g = net.loss_and_grads(x, steps, y, pos_weight=0.0)
    r = np.random.default_rng(2)
    for k, v in net.p.items():
        flat, grad = v.reshape(-1), g[k].reshape(-1)
        for i in r.choice(len(flat), min(12, len(flat)), replace=False):
            if k == "P" and i < v[0].size:
                continue
            old, eps = flat[i], 1e-4
            flat[i] = old + eps
            up = net.loss_and_grads(x, steps, y, 0.0)[0]
            flat[i] = old - eps
            down = net.loss_and_grads(x, steps, y, 0.0)[0]
            flat[i] = old
            assert abs((up - down) / 2 / eps - grad[i]) < 2e-3 + 0.05 * abs(grad[i]), (k, i)


def test_batched_logits_equal_single_ones():
    texts = [b"abc", b"a longer text of some words", b"", b"x" * 100]
    net = gru.ByteGRU(["a", "b"], 6, 1, gru.pairs_of([b"".join(texts)], 1))
    net.p["P"][1:] = np.random.default_rng(1).standard_normal(net.p["P"][1:].shape) * 0.1
    whole = net.logits(texts, batch=3)
    for i, t in enumerate(texts):
        assert np.allclose(net.logits([t])[0], whole[i], atol=1e-4)
    at = net.position_logits(texts[1])
    assert at.shape == (len(texts[1]), 2) and np.allclose(net.logits([texts[1]])[0], at[::8].mean(0), atol=0.2)


def test_sentences():
    t = language.plain("Wie M. Trivorker und Dr. Who sagen. (Beifall!) Gut – Laughter – so? [Ha. Ho.]\nJa - nein!\n\n\"C'est bon.\" Ende")
    got = [t[s:e] for s, e in language.sentences(t)]
    assert [g.split()[0] for g in got][:1] == ["wie"] and len(got) == 5 and got[-1] == "ende"
    assert language.sentences("") == [] and language.sentences(" ... ") == []
    assert len(language.sentences("(nur ein zwischenruf)")) == 1
    stray = "eins – zwei drei. vier fünf. sechs – sieben acht."
    assert len(language.sentences(stray)) == 3


@pytest.fixture(scope="module")
def net(spark, data):
    rows = [(r.lang, r.text, r.sample_id) for r in spark.read.parquet(f"{data}/lang_samples.parquet").collect()]
    held = [x for x in rows if x[2] % 5 == 0]
    return language.train(sorted((g, t) for g, t, i in rows if i % 5), epochs=30), held


def test_held_out_accuracy(net):
    model, held = net
    got = language.label_texts(model, [t for _, t, _ in held])
    assert np.mean([g == r[0][0] for (g, _, _), r in zip(held, got)]) >= 0.97
    up = language.label_texts(model, [t.upper() for _, t, _ in held])
    assert np.mean([g == r[0][0] for (g, _, _), r in zip(held, up)]) >= 0.97


def test_mixed_texts_and_cases(net):
    model, held = net
    by = {g: t for g, t, _ in held}
    quote = ' "I would like to ask a question here today." '
    texts = [None, "", "  \n", "!!! 123", by["de"] * 3 + " " + by["fr"] * 4, by["de"] * 2 + quote + by["de"] * 2, "(" + by["en"] + ")", by["nl"].replace(" ", "\n") * 50]
    got = language.label_texts(model, texts)
    assert got[:4] == [None] * 4
    assert got[4][0] == ["de", "fr"] and got[5][0] == ["de"] and got[6][0] == ["en"] and got[7][0] == ["nl"]
    around = "Der Ausschuss berät den Antrag. " * 4 + quote + "Wir stimmen heute über den Bericht ab." + quote
    assert language.label_texts(model, [around])[0][0] == ["de"]
    for r in got[4:]:
        assert all(0 < s["confidence"] <= 1 and s["start"] < s["end"] for s in r[1])


def test_language_operator(spark, net):
    model, held = net
    df = spark.createDataFrame([(i, t, g) for g, t, i in held] + [(None, None, None), (7, "", "x")], "id long, text string, lang string")
    out = language.languages(df, F.col("id"), F.col("text"), model, F.col("lang")).collect()
    assert len(out) == len(held) and np.mean([x.label in x.langs for x in out]) >= 0.97
    assert language.languages(df.limit(0), F.col("id"), F.col("text"), model).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, data, name):
    from pathlib import Path

    import duckdb

    import compare
    from merloom.llm.sql import SQL

    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(compare.norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name in SQL:
        con = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        cur = con.execute(SQL[name])
        at = [[c[0] for c in cur.description].index(c) for c in cols]
        assert got == sorted(tuple(compare.norm(r[i]) for i in at) for r in cur.fetchall())
