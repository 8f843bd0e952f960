"""Streamed scrubbing of documents without a usable number."""

from hushframe.plans.queries import queries


def test_no_row_is_lost(spark, tmp_path):
    rows = [(i, f"mail a{i}@b.com", "en", "s") for i in range(9)]
    rows += [(None, "no number", "en", "s"), (-4, "below zero", "en", "s")]
    schema = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["stream_scrub"](spark, str(tmp_path)).collect()
    assert sorted((r["seq"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
