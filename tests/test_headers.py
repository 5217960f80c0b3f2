"""Headers without an accession have entries of their own."""

from merloom.plans import registry


def test_all_headers_have_an_entry(spark, data):
    q = registry.queries()
    n = spark.read.parquet(f"{data}/read_chunks.parquet").where("trim(name) <> ''").selectExpr("count(distinct name)").first()[0]
    assert q["content_numbered_headers"](spark, data).count() > q["content_numbered"](spark, data).count()
    assert q["content_numbered_headers"](spark, data).count() <= n
    dummies = {t for (t,) in q["content_generate_lowest_headers"](spark, data).where("name like 'EWAN%'").select("tax").collect()}
    assert dummies & {t for (t,) in q["reference_sequences_headers"](spark, data).select("tax").distinct().collect()}
    assert dummies & {t for (t,) in q["index_from_references_headers"](spark, data).select("tax").distinct().collect()}
