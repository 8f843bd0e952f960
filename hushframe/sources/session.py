"""Session settings that the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

STATE_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables and stream checkpoints.

    This is what the cluster names in ``spark.checkpoint.dir``.  Only where that
    is unset (local runs and tests) a temporary folder is made and recorded.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hushframe-")
        spark.conf.set(key, folder)
    return folder.rstrip("/")
