"""Keyed-table semantics: the last write of a key counts, and reads are joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_written(writes: DataFrame, key: str, order: str) -> DataFrame:
    """The table after all writes: of each key its last row (a maximum with partial aggregation)."""
    rest = [c for c in writes.columns if c not in (key, order)]
    last = writes.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in (order, *rest)])


def upserted(table: DataFrame, writes: DataFrame, key: str, order: str) -> DataFrame:
    """table with the last writes of their keys."""
    new = last_written(writes, key, order).select(*table.columns)
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def found(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """keys with the table's columns, null for unknown keys, and exists."""
    return keys.join(table.withColumn("_known", F.lit(True)), key, "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")


def valid_name(c: Column | str, least: int = 3) -> Column:
    """Letters and digits only, at least so many."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((F.length(c) >= least) & c.rlike(r"(?U)^\p{Alnum}+$"), F.lit(False))
