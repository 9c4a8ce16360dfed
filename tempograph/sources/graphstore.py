"""A graph as Parquet: a folder per kind of node, edges by label; and writes that change nothing when repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M


def save(graph: M.Graph, folder: str) -> None:
    """Write the graph; a kind whose ids aren't unique is refused before anything is written."""
    for kind, df in graph.nodes.items():
        if not M.unique_ids(df):
            raise ValueError(f"{kind}: ids are not unique")
    for kind, df in graph.nodes.items():
        df.write.mode("overwrite").parquet(f"{folder}/nodes/{kind}")
    for name, df in (("edges", graph.edges), ("edges_all", graph.edges_all)):
        df.repartition("label").write.mode("overwrite").partitionBy("label").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> M.Graph:
    """A saved graph; a traversal of one label reads that label's files only."""
    nodes = {kind: spark.read.parquet(f"{folder}/nodes/{kind}") for kind in M.KINDS}
    edges, every = (spark.read.parquet(f"{folder}/{name}").select(*M.EDGE_COLUMNS) for name in ("edges", "edges_all"))
    return M.Graph(nodes, edges, every)


def new_nodes(stored: DataFrame, incoming: DataFrame, keys: tuple = ("node_id",), order: str = "ord") -> DataFrame:
    """What of incoming is to be appended: of each key that isn't stored, the first row."""
    from ..operators.ordered import first_per_key

    return first_per_key(incoming, list(keys), order).join(stored.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def new_edges(stored: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """What of incoming (from_id, label, to_id, ord, ...) is to be appended: edges that aren't stored and whose ends are among nodes."""
    fresh = new_nodes(stored, incoming, ("from_id", "label", "to_id"))
    ids = nodes.select(F.col("node_id").alias("_id")).distinct()
    return fresh.join(ids, fresh["from_id"] == ids["_id"], "left_semi").join(ids, fresh["to_id"] == ids["_id"], "left_semi")
