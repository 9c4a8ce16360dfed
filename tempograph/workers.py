"""Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package, from whatever folder the driver was started."""
    env = spark.sparkContext.environment
    found = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in found:
        env["PYTHONPATH"] = ":".join([*found, ROOT])
    return spark
