"""JSON documents of a graph: the payload, the explorer's document, and their readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..functions.viz import without_keys

PROPERTIES = {
    M.COMMIT: ("hash", "author", "msg", "timestamp", "ai_rationale"), M.FILE: ("file", "external"), M.CLASS: ("name", "file"), M.FUNCTION: ("name", "file"),
    M.STATE: ("code", "code_hash", "commit", "function_id", "ai_summary", "ai_summary_vec", "status"),
}
PAYLOAD = "nodes array<map<string,string>>, edges array<struct<`from`:string,label:string,`to`:string>>"


def payload_nodes(graph: M.Graph, every_touch: bool = True) -> DataFrame:
    """ord, doc: {type, id, ...properties} of each node; every_touch: once for each time a commit touched it."""
    rows = {k: v for k, v in graph.nodes.items()}
    if every_touch and graph.states_all is not None:
        f, c = graph.extra["functions_all"], graph.extra["classes_all"]
        rows |= {M.STATE: graph.states_all, M.FILE: graph.files_all, M.CLASS: c, M.FUNCTION: f.select(F.col("function_id").alias("node_id"), "name", F.col("path").alias("file"), "ord")}
    out = []
    for kind, df in rows.items():
        fields = [F.lit(kind).alias("type"), F.col("node_id").alias("id"), *[F.col(p) for p in PROPERTIES[kind]]]
        out.append(df.select("ord", F.to_json(F.struct(*fields)).alias("doc")))
    return reduce(DataFrame.unionByName, out)


def payload_edges(graph: M.Graph) -> DataFrame:
    return graph.edges_all.select("ord", F.to_json(F.struct(F.col("from_id").alias("from"), "label", F.col("to_id").alias("to"))).alias("doc"))


def write_json_lines(graph: M.Graph, folder: str) -> None:
    """nodes and edges as JSON lines, in parallel: the form for large graphs."""
    payload_nodes(graph).select(F.col("doc").alias("value")).write.mode("overwrite").text(f"{folder}/nodes")
    payload_edges(graph).select(F.col("doc").alias("value")).write.mode("overwrite").text(f"{folder}/edges")


def write_document(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[int, int]:
    """One JSON document {nodes, edges} from docs in their order, streamed through the driver partition by partition."""
    n = [0, 0]
    with open(path, "w", encoding="utf-8") as out:
        for k, (name, df) in enumerate((("nodes", nodes), ("edges", edges))):
            out.write(f'{"{" if not k else ", "}"{name}": [')
            for row in df.orderBy("ord").select("doc").toLocalIterator():
                out.write((", " if n[k] else "") + row[0])
                n[k] += 1
            out.write("]")
        out.write("}")
    return n[0], n[1]


def viz_nodes(nodes: DataFrame, rebuilt: bool = True) -> DataFrame:
    """id, kind, label, summary, status, metadata of nodes (type, id, props: a map of strings).

    status is always `active`: the real one is only in the metadata.  rebuilt: as rebuilt from the payload; else as ingestion writes it.
    """
    p = lambda k: F.try_element_at(F.col("props"), F.lit(k))
    if rebuilt:
        label, summary = X.rebuilt_label(p("name"), p("msg"), p("file"), F.col("id")), X.rebuilt_summary(p("ai_rationale"), p("ai_summary"), p("code"))
    else:
        label, summary = X.viz_label(p("name"), p("msg"), p("file"), F.col("id")), X.viz_summary(p("ai_summary"), p("ai_rationale"), p("code"))
    return nodes.select("id", F.col("type").alias("kind"), label.alias("label"), summary.alias("summary"), F.lit("active").alias("status"), without_keys("props", "type", "id").alias("metadata"))


def viz_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.col("label").alias("kind"))


def graph_viz(graph: M.Graph, rebuilt: bool = True) -> tuple[DataFrame, DataFrame]:
    nodes = graph.nodes_all().select(F.col("kind").alias("type"), F.col("node_id").alias("id"), "props")
    return viz_nodes(nodes, rebuilt), viz_edges(graph.edges_all)


def as_docs(df: DataFrame, order: Column) -> DataFrame:
    return df.select(order.alias("ord"), F.to_json(F.struct(*df.columns)).alias("doc"))


def read_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (type, id, props) and edges (from_id, label, to_id) of a payload document."""
    doc = spark.read.schema(PAYLOAD).option("mode", "FAILFAST").json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("props")).select(F.col("props")["type"].alias("type"), F.col("props")["id"].alias("id"), without_keys("props", "type", "id").alias("props"))
    edges = doc.select(F.inline("edges")).select(F.col("from").alias("from_id"), "label", F.col("to").alias("to_id"))
    return nodes, edges


def read_viz(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    schema = "nodes array<struct<id:string,kind:string,label:string,summary:string,status:string,metadata:map<string,string>>>, edges array<struct<source:string,target:string,kind:string>>"
    doc = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))
