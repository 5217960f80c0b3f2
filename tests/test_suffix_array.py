from merloom.operators import sequence_store


def test_doubling_goes_on_until_all_ranks_differ(spark, monkeypatch):
    rounds = []
    dense = sequence_store._dense
    monkeypatch.setattr(sequence_store, "_dense", lambda x: rounds.append(1) or dense(x))
    for text, most in (("ab" * 8, 5), ("abcdefghijklmnop", 1)):
        rounds.clear()
        got = sequence_store.suffix_array(spark.createDataFrame(list(enumerate(text)), "pos int, c string")).orderBy("place").collect()
        assert [r.pos for r in got] == sorted(range(len(text)), key=lambda i: text[i:])
        assert len(rounds) <= most
