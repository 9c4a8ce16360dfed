"""The driver's tables seen as a temporal graph.

orders are commits (in the order of date and key), parts are functions, a state is a part in an order, and a part calls the part of
the next line of the same order, where both lines have at least a quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("node_id"), F.concat(F.lit("hash"), F.col("o_orderkey")).alias("hash"), F.date_format("o_orderdate", ISO).alias("timestamp"), F.col("o_orderpriority").alias("msg"), "o_orderdate")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part and order of each state."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("commit")).distinct()


def ordered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"))
    return touched(spark, sf_dir).join(o, "commit")


def state_key(part="part", commit="commit"):
    return F.concat(F.lit("state_"), F.col(part), F.lit("_"), F.col(commit))


def calls(spark: SparkSession, sf_dir: str, quantity: float) -> DataFrame:
    """Distinct edges from_id -> to_id."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= quantity).select("l_orderkey", "l_partkey", "l_linenumber")
    a = li.select("l_orderkey", F.col("l_partkey").alias("from_id"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    b = li.select("l_orderkey", F.col("l_partkey").alias("to_id"), "l_linenumber")
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("from_id <> to_id").select("from_id", "to_id").distinct()


def edges(spark: SparkSession, sf_dir: str, quantity: float) -> DataFrame:
    """CALLS, HAS_STATE and GENERATED edges; ids of commits, parts and states as strings."""
    s = touched(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    one = calls(spark, sf_dir, quantity).select(text("from_id").alias("from_id"), F.lit("CALLS").alias("label"), text("to_id").alias("to_id"))
    two = s.select(text("part").alias("from_id"), F.lit("HAS_STATE").alias("label"), state_key().alias("to_id"))
    three = s.select(text("commit").alias("from_id"), F.lit("GENERATED").alias("label"), state_key().alias("to_id"))
    return one.unionByName(two).unionByName(three)


def contains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Explorer nodes (id, kind, label, summary, status) and edges (source, target, kind) of regions, nations, suppliers."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    node = lambda df, kind, key, name, status: df.select(F.concat(F.lit(f"{kind}_"), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("label"), F.concat(F.lit("the "), F.lower(name)).alias("summary"), status.alias("status"))
    active = F.lit("active")
    nodes = node(region, "Repo", "r_regionkey", "r_name", active).unionByName(node(nation, "File", "n_nationkey", "n_name", active))
    nodes = nodes.unionByName(node(supplier, "Symbol", "s_suppkey", "s_name", F.when(F.col("s_acctbal") < 0, "stale").otherwise("active")))
    edge = lambda df, a, ka, b, kb, kind: df.select(F.concat(F.lit(f"{ka}_"), F.col(a)).alias("source"), F.concat(F.lit(f"{kb}_"), F.col(b)).alias("target"), F.lit(kind).alias("kind"))
    rich = supplier.where("s_acctbal > 1000")
    e = edge(nation, "n_regionkey", "Repo", "n_nationkey", "File", "CONTAINS").unionByName(edge(rich, "s_nationkey", "File", "s_suppkey", "Symbol", "DEFINES"))
    return nodes, e
