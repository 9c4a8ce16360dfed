"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank (rank + 1/2) / rows
of its source spreads every source evenly over 0 to 1; the order of fractional ranks is cut into shards whose
row counts differ by one at most.  So each shard has each source in the proportion of the whole.

Law `rows`.  Ranks come from sums over hash buckets (`common.running`), so a source with a third of all rows
is ordered by many tasks.  Texts are not moved: only the id, source, size and checksum are.

Nulls: a null source is a source of its own, a null id one more value, a null text has no bytes.  Rows that
agree in id, source, size and checksum are interchangeable, other ties go by these.  Very long texts are only measured.  Empty tables
give empty results; other columns are ignored.  Windows run over one row per bucket of ROWS_PER_BUCKET rows (of a source, and of all).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, hash_bucket, hash_order, running, stored, table

N_SHARDS = 40
ROWS_PER_BUCKET = 2_000


def keys_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("stratum"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
    )


def interleave(keys: DataFrame, n_shards: int = N_SHARDS, seed: str = "shards", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """keys (id, stratum, size, crc) with rank, stratum_rows, shard and slot."""
    keys = stored(keys.withColumn("_h", hash_order(seed, "id")), "shard_keys")
    n = keys.count()
    nb = buckets(n, rows_per_bucket)
    tie = ["_h", "id", "crc", "size"]
    df = keys.withColumns({"_one": F.lit(1).cast("long"), "_b": hash_bucket(F.col("_h"), nb)})
    df = running(df, ["stratum"], "_b", tie, "_one", "rank", total="stratum_rows")
    df = df.withColumn("_f", (2 * F.col("rank") + 1) / (2 * F.col("stratum_rows")))
    df = df.withColumns({"_b": F.least(F.floor(F.col("_f") * nb), F.lit(nb - 1)).cast("long"), "_all": F.lit(0)})
    df = running(df, ["_all"], "_b", ["_f", *tie, "stratum"], "_one", "_at")
    # shard s begins at the first position p with p * n_shards >= s * n
    df = df.withColumn("shard", F.expr(f"(_at * {n_shards}L) div {max(n, 1)}L").cast("int"))
    begin = F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return df.withColumn("slot", (F.col("_at") - begin).cast("long")).drop("_h", "_b", "_f", "_at", "_all", "_one")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write docs (unique ids) as one folder per shard, in files of about rows_per_file rows of consecutive slots; only here do texts move."""
    placed = docs.join(assigned.select(F.col("id").alias("_id"), "shard", "slot"), docs[id_col].eqNullSafe(F.col("_id"))).drop("_id")
    placed = placed.withColumn("part", F.expr(f"slot div {rows_per_file}L"))
    placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(path)


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(keys_of(table(spark, sf_dir, "documents")))
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"),
    )
