"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder in local mode, which has one machine, and an error elsewhere."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tempograph-"))
    return _own_folder[0]


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_folder(spark)}/tempograph/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the run's folder and read again: lineage ends here, and a lost executor costs no recomputation.

    The files go when the enclosing `scratch` ends, or with `drop_stored`, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    folder, fs = _path(spark, run_folder(spark))
    fs.deleteOnExit(folder)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end, but for those stored under `kept`."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p, fs = _path(spark, path.rsplit("/", 1)[0])
            fs.delete(p, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """stored, in the scope around the present one: the result of a `scratch`."""
    inner = _scopes.pop() if _scopes else None
    try:
        return stored(df, name)
    finally:
        if inner is not None:
            _scopes.append(inner)


def drop_stored(spark: SparkSession) -> None:
    """Delete everything that this application stored; call it once no DataFrame made here is needed."""
    p, fs = _path(spark, run_folder(spark))
    fs.delete(p, True)
