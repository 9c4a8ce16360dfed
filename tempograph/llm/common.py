"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..storage import drop_stored, kept, scratch

__all__ = ["SPACES", "attach", "buckets", "drop_stored", "hash_bucket", "hash_order", "kept", "running", "scratch", "stored", "table", "words"]

#: ASCII white space, the only word separator of these operators.
SPACES = r"[\x20\x09-\x0D]+"

#: rows of a file of a table whose size is known
ROWS_PER_FILE = 100_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """`storage.stored`.  rows: about how many at most, if known, so that a small table isn't written as many files."""
    return storage.stored(df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE))), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def buckets(rows: int, rows_per_bucket: int) -> int:
    return max(1, -(-rows // rows_per_bucket))


def hash_order(seed: str, *cols: str) -> Column:
    """A seeded pseudo-random hexadecimal sort key of the columns (null unlike any string)."""
    return F.md5(F.concat(F.lit(seed), *[F.coalesce(F.concat(F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in cols]))


def hash_bucket(key: Column, n: int) -> Column:
    """Bucket 0 to n-1 of a hexadecimal key, in the order of the keys."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 32)).cast("long")


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str, total: str | None = None) -> DataFrame:
    """df with out: the sum of value over the rows before, within the group, in the order of (bucket, order).

    No task sees a whole group: sums of buckets come first, by partial aggregation, and only they are
    accumulated per group; rows are ordered within their bucket.  total: the group's sum, if named.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    along = W.partitionBy(*group).orderBy(bucket)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if total:
        sums = sums.withColumn(total, F.sum("_sum").over(W.partitionBy(*group)))
    sums = sums.drop("_sum").toDF(*[f"_k{i}" for i in range(len(keys))], "_ahead", *([total] if total else []))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = [rows[k].eqNullSafe(sums[f"_k{i}"]) for i, k in enumerate(keys)]
    return rows.join(sums, on).withColumn(out, (F.col("_ahead") + F.col("_in")).cast("long")).drop("_ahead", "_in", *[f"_k{i}" for i in range(len(keys))])


#: rows of a side that may be broadcast, after counting them; some hundred bytes each
BROADCAST_ROWS = 50_000


def attach(df: DataFrame, small: DataFrame, on: Column, how: str = "inner", rows: int | None = None) -> DataFrame:
    """df joined with a stored table of one row per group: broadcast if its rows (counted, if not given) are few, else by an
    ordinary join, whose large side adaptive execution splits where a group is hot."""
    n = small.count() if rows is None else rows
    return df.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)
