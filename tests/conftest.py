import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def messages(spark):
    """Make messages from texts or (text, lang) pairs, in one scope."""

    def make(*texts, scope="s"):
        rows = []
        for i, text in enumerate(texts):
            body, lang = text if isinstance(text, tuple) else (text, "en")
            rows.append((scope, i, body, lang))
        return spark.createDataFrame(
            rows, "scope_id string, seq bigint, text string, lang string"
        )

    return make
