import __spark_entry__

TABLES = "/root/testdata/sf0.001"


def test_every_strategy_has_rows(spark):
    """The registered searches reach every branch: complex questions search in several steps."""
    rows = __spark_entry__.queries()["adaptive_search_all"](spark, TABLES).collect()
    asked = {r.item_id for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()}
    found = {s: {r.query_id for r in rows if r.strategy == s and r.chunk_id is not None} for s in ("single_step", "multi_step")}
    assert found["multi_step"] == {i for i in asked if i % 4 == 3}
    assert found["single_step"] == {i for i in asked if i % 4 in (0, 2)}
