from merloom.llm import queries


def test_found_rows_come_through_the_chain(spark, monkeypatch):
    rows = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False)], "id long, said_seen boolean, seen boolean")
    monkeypatch.setattr(queries, "_answers", lambda s, d: rows)
    assert [r.pair_id for r in queries.p2_found(spark, "").collect()] == [1]
