"""A document of more pages than one request may ask for."""

from stratalake.plans import queries as plans


def test_long_document(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 64 * 4097), (2, "y" * 10)], "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.queries()["has_pages"](spark, str(tmp_path)).collect()
    assert sorted((r["request"], r["present"]) for r in got) == [(1, False)] * 4097 + [(2, True)]
