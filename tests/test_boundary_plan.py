"""The keywords of boundaries are sought in a text that is lowered once."""

from lodestar.plans import catalogue


def test_a_page_is_lowered_once(spark, tmp_path):
    rows = [(1, "x"), (2, "HTTP Request to a TABLE"), (3, "Select FROM db, cache of Redis"), (4, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = catalogue.queries()["boundary_keywords"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {(2, "http", 2, 0.65), (3, "database", 2, 0.65), (3, "cache", 2, 0.65)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
