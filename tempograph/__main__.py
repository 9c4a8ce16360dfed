"""python -m tempograph ingest|enrich|export|call|serve: the engine from the command line.

ingest REPOSITORY FOLDER   replay a git repository into a saved graph, with payload and explorer documents
enrich FOLDER              summaries and rationales into the saved graph (FOLDER-enriched)
export FOLDER FILE         the explorer's document of a saved graph
call FOLDER TOOL JSON      one tool call
serve FOLDER [PORT]        the tools over HTTP
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import model as M
from .operators import enrich, export
from .operators.fold import replay
from .sources import gitlog, graphstore
from .tools import Tools, serve


def write_viz(graph: M.Graph, path: str, rebuilt: bool = True) -> tuple[int, int]:
    nodes, edges = export.graph_viz(graph, rebuilt)
    return export.write_document(export.as_docs(nodes, F.struct("kind", "id")), export.as_docs(edges, F.struct("kind", "source", "target")), path)


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tempograph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    command, folder = args[0], args[2] if args[0] == "ingest" else args[1]
    if command == "ingest":
        graph = replay(gitlog.read_git(spark, args[1], *args[3:4]))
        export.write_json_lines(graph, f"{folder}/payload")
        graphstore.save(graph, folder)
        saved = graphstore.load(spark, folder)
        export.write_document(export.payload_nodes(graph), export.payload_edges(graph), f"{folder}/graph_payload.json")
        write_viz(saved, f"{folder}/graph_viz.json", rebuilt=False)
        print({k: v.count() for k, v in saved.nodes.items()}, saved.edges.count(), "edges")
        return 0
    graph = graphstore.load(spark, folder)
    if command == "enrich":
        graphstore.save(enrich.enriched(graph), f"{folder}-enriched")
    elif command == "export":
        print(write_viz(graph, args[2]))
    elif command == "call":
        print(json.dumps(Tools(graph).call(args[2], json.loads(args[3])), indent=2))
    elif command == "serve":
        serve(Tools(graph), port=int(args[2]) if len(args) > 2 else 7700).serve_forever()
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
