"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: Bytes of an Arrow batch where the session leaves Spark's default: a worker holds a batch and what it makes of it.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "8m", "67108864b"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver started elsewhere; keep Arrow batches small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, DEFAULT_BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark
