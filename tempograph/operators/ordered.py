"""Order-dependent operators as aggregations and windows that no single task has to carry alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The row of each key that comes first: a minimum with partial aggregation, so repeated keys collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.min(F.struct(F.col(order), *rest)).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (*rest, order)])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The last n rows of each key (a window that keeps no more than n rows per key before the shuffle)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def following(df: DataFrame, id_col: str, order: list[str], bucket: Column) -> DataFrame:
    """df with next_id: the id of the row that comes next in the global order, null for the last.

    bucket must rise with the order.  Rows look ahead within their bucket; the last one of a bucket gets the head of the next
    bucket that has rows, from a table of one row per bucket.
    """
    df = df.withColumn("_bucket", bucket)
    inside = W.partitionBy("_bucket").orderBy(*order)
    heads = df.groupBy("_bucket").agg(F.min(F.struct(*order, F.col(id_col).alias("_id"))).alias("_head"))
    heads = heads.select(F.col("_bucket").alias("_b"), F.lead("_head._id").over(W.orderBy("_bucket")).alias("_next_head"))
    df = df.withColumn("_next", F.lead(id_col).over(inside)).join(heads, F.col("_bucket") == F.col("_b"))
    return df.withColumn("next_id", F.coalesce("_next", "_next_head")).drop("_bucket", "_b", "_next", "_next_head")


def asof_last(definitions: DataFrame, uses: DataFrame, key: str, order: str, value: str, bucket: str | None = None) -> DataFrame:
    """uses with value: that of the last definition of the same key at or before the use; null if there is none.

    definitions (key, order, value), uses (key, order, ...).  bucket: a column of both that rises with the order; each key's
    rows are then ordered bucket by bucket, and a key's value at the start of a bucket comes from a table of one row per key
    and bucket with definitions, so that a key with most of all rows is shared by many tasks.
    """
    b = F.col(bucket) if bucket else F.lit(0)
    rest = [c for c in uses.columns if c not in (key, order)]
    d = definitions.select(F.col(key).alias("_key"), F.col(order).alias("_order"), b.alias("_bucket"), F.lit(0).alias("_tag"), F.col(value).alias("_value"), F.lit(None).cast(uses.select(F.struct(*rest)).schema[0].dataType).alias("_rest"))
    u = uses.select(F.col(key).alias("_key"), F.col(order).alias("_order"), b.alias("_bucket"), F.lit(1).alias("_tag"), F.lit(None).cast(definitions.schema[value].dataType).alias("_value"), F.struct(*rest).alias("_rest"))
    rows = d.unionByName(u)
    carried = None
    if bucket:
        # the last value of each key and bucket becomes, in each later bucket that uses the key, a definition before all rows
        last = rows.groupBy("_key", "_bucket").agg(F.max(F.when(F.col("_tag") == 0, F.struct("_order", "_value"))).alias("_last"))
        before = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        carried = last.withColumn("_was", F.last("_last._value", True).over(before)).select(F.col("_key").alias("_k"), F.col("_bucket").alias("_b"), "_was")
    along = W.partitionBy("_key", "_bucket").orderBy("_order", "_tag").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last("_value", True).over(along)).where("_tag = 1")
    if carried is not None:
        found = found.join(carried, (F.col("_key") == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left").withColumn("_found", F.coalesce("_found", "_was"))
    return found.select(F.col("_key").alias(key), F.col("_order").alias(order), "_rest.*", F.col("_found").alias(value))


def chained(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """df with previous and next (value of the rows before and after within the key) and version (from 1)."""
    along = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"previous": F.lag(value).over(along), "next": F.lead(value).over(along), "version": F.row_number().over(along).cast("long")})


def with_change(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """df with changed: whether value differs from that of the row before within the key; false for the first."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("changed", F.coalesce(F.col(value) != before, F.lit(False)))


def with_status(df: DataFrame, keys: list[str], order: list, value: str, active: str, other: str) -> DataFrame:
    """df with status: active where value is that of the key's last row (a maximum with partial aggregation, joined back)."""
    names = [f"_key{i}" for i in range(len(keys))]
    head = last_value(df, keys, order, value).toDF(*names, "_head")
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return df.join(head, on).withColumn("status", F.when(F.col(value) == F.col("_head"), active).otherwise(other)).drop("_head", *names)


def last_value(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """keys and value of each key's last row."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def with_ends(edges: DataFrame, known: DataFrame, at: Column) -> DataFrame:
    """The edges (from_id, from_kind, to_id, to_kind, ...) both of whose ends are known (kind, id, since) at the edge's time: two semi-joins."""
    k = known.select(F.col("kind").alias("_kind"), F.col("id").alias("_id"), F.col("since").alias("_since"))
    for end in ("from", "to"):
        edges = edges.join(k, (F.col(f"{end}_id") == F.col("_id")) & (F.col(f"{end}_kind") == F.col("_kind")) & (F.col("_since") <= at), "left_semi")
    return edges
