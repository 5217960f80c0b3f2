import pytest
from pyspark.sql import functions as F

from merloom import session
from merloom.operators import content, identify, index, profile, reads, reports, sequence_store, windows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcasts_are_measured(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "10485760b")
        spark.conf.unset(names[1])
        session.measured_broadcasts(spark)
        session.measured_broadcasts(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10485760b"
        # a generator that makes a thousand rows of one is not broadcast on its estimate
        many = spark.range(5).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("k"))
        assert "SortMergeJoin" in plan_of(spark.range(10**6).withColumnRenamed("id", "k").join(many, "k"))
        assert "BroadcastHashJoin" in plan_of(spark.range(10**6).join(session.small(spark.range(3)), "id"))
        assert "BroadcastHashJoin" not in plan_of(spark.range(10**6).join(session.small(spark.range(30), rows=10), "id"))
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_the_shared_folder(spark, monkeypatch, tmp_path):
    import os

    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    path = session.new_path(spark)
    assert path.startswith(session.shared_folder(spark)) and not session.exists(spark, path)
    spark.range(3).write.parquet(path)
    assert session.exists(spark, path + "/_SUCCESS")

    class Unset:
        def __init__(self, master):
            self.conf = self
            self.sparkContext = type("S", (), {"master": master})

        def get(self, key, default=None):
            return default

    own = session.shared_folder(Unset("local[4]"))
    assert own == session.shared_folder(Unset("local[2]")) and os.path.isdir(own[7:])
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            session.shared_folder(Unset(master))


def test_written_tables_are_read_back(spark):
    df = spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<int>")
    assert session.materialise(df).collect() == df.collect()
    assert session.materialise(df.limit(0)).schema == df.schema and session.materialise(df.limit(0)).count() == 0


def test_empty_tables(spark):
    idx = index.build(spark.createDataFrame([], "c long, t long"), F.col("c"), F.col("t"))
    for f in (index.frequencies, index.directory, index.redundancy, index.frequent_kmers, index.csr, index.shrink_entropy, index.shrink_halve, index.shrink_overrepresented, index.repack_odd_letters, index.hash_pairs):
        assert f(idx).count() == 0, f
    assert index.shrink_every_nth(idx, 50).count() == 0
    assert index.redundancy_cutoff(idx).first().cutoff is None
    seqs = spark.createDataFrame([], "read_id long, mate int, seq string")
    w = windows.kmer_windows(seqs, F.col("seq"), ["read_id"])
    scores = identify.read_scores(identify.match(w, idx, ["read_id"], 7, 12), ["read_id"])
    r = spark.createDataFrame([], "read_id long, name string, seq_len long")
    rated = identify.rate(scores, r, idx.groupBy("tax").agg(F.count("code").alias("n")), ["read_id"], 7, 12)
    hits = identify.rank_hits(rated, ["read_id"])
    names = spark.createDataFrame([], "tax long, name string, name_class string")
    n = r.agg(F.count("*").alias("n"))
    assert hits.count() == reports.read_json(r, hits, names).count() == reports.read_frequencies(hits, ["read_id"], n).count() == 0
    rel = profile.relative(identify.taxon_counts(w, idx, 7, 12), profile.input_size(w.agg(F.count("*").alias("n")), n, 7, 12))
    assert rel.count() == 0 and profile.wide(rel, 7, 12).count() == 0
    assert {x.overall_rel for x in profile.not_identified(rel, profile.input_size(n, n, 7, 12)).collect()} == {1.0}
    assert identify.coherence(identify.longest_matches(w, idx, ["read_id"], 7, 12), ["read_id"]).count() == 0
    nodes = spark.createDataFrame([], "tax long, parent long, rank_name string")
    acc = spark.createDataFrame([], "accession string, tax long")
    c = content.generate(acc, acc, nodes, names)
    assert c.count() == 0 and content.merge(c, c)[0].count() == 0 and content.repair(c).count() == 0 and content.ordinals(c).count() == 0
    assert reports.lift(nodes, acc, "genus").count() == 0
    assert windows.open_frames(seqs, F.col("seq"), ["read_id"]).count() == 0
    assert reads.pairs(spark.createDataFrame([], "read_id long, mate int, name string, seq string, seq_len long")).count() == 0
    assert sequence_store.ranked(idx, F.col("code")).count() == 0
    assert sequence_store.unique_consecutive(sequence_store.ranked(idx, F.col("code")), "tax").count() == 0


def test_null_rows(spark):
    seqs = spark.createDataFrame([(None, None), (1, None), (None, "ACGTTTGACC" * 5)], "read_id long, seq string")
    w = windows.kmer_windows(seqs, F.upper("seq"), ["read_id"])
    assert w.count() == 50 - 20
    idx = index.build(w, F.col("code"), F.lit(5).cast("long"))
    got = identify.read_scores(identify.match(w, idx, ["read_id"], 12, 12), ["read_id"]).collect()
    assert [(x.read_id, x.tax) for x in got] == [(None, 5)]
