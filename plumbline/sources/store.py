"""Results materialised under the fingerprint of what they come from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def materialized(spark: SparkSession, root: str, parts: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under this fingerprint, or the one that `make` gives, kept for the next time. Any path that Spark writes."""
    path = f"{root}/{fingerprint(*parts)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):  # a write that did not end is none
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
