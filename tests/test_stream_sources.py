"""Stream queries over a table of several part files."""

import os

import pytest

from hushframe.plans.queries import queries


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(4, "doc_id").write.parquet(f"{folder}/documents.parquet")
    assert sum(name.endswith(".parquet") for name in os.listdir(f"{folder}/documents.parquet")) == 4
    return str(folder)


@pytest.mark.parametrize("name", ["stream_analyze", "stream_tokenise", "stream_vault", "stream_scrub_count"])
def test_part_files_equal_the_single_file(spark, sf_dir, parts, name):
    want = sorted(map(str, queries()[name](spark, sf_dir).collect()))
    assert want and sorted(map(str, queries()[name](spark, parts).collect())) == want
