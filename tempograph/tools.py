"""The five graph tools as methods that return DataFrames, and their JSON dispatch."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model as M
from .functions.patch import replace_function
from .operators import traverse, vector

STATE_COLUMNS = ["node_id", "ai_summary", "code", "commit", "status"]


def _tool(name: str, description: str, required: list[str], **properties: tuple) -> dict:
    fields = {k: {"type": t, "description": d, **({"default": x[0]} if x else {})} for k, (t, d, *x) in properties.items()}
    return {"name": name, "description": description, "parameters": {"type": "object", "properties": fields, "required": required}}


# Tool names, parameters and defaults that clients rely on.
MANIFEST = {
    "schema_version": "v1",
    "name": "tempograph",
    "description": "Temporal code-graph tools on Spark",
    "tools": [
        _tool("search_code_semantics", "Active functions by what they do.", ["prompt"], prompt=("string", "What to look for"), k=("integer", "Number of results", 5)),
        _tool("get_code_time_travel_diff", "A function state and the one before it.", ["state_node_id"], state_node_id=("string", "Id of a function state")),
        _tool("trace_blast_radius", "All functions that call a function, over some hops.", ["function_identity_id"], function_identity_id=("string", "Id of a function"), depth=("integer", "Most hops", 3)),
        _tool("get_temporal_vulnerability_trace", "Commits before a date that made states of a function's callers.", ["target_func", "timestamp_iso"], target_func=("string", "Name of a function"), timestamp_iso=("string", "ISO 8601 time")),
        _tool("edit_code", "Replace a function in the working tree and ingest the change.", ["file", "function_name", "new_code"], file=("string", "Path in the repository"), function_name=("string", "Name of the function"), new_code=("string", "The whole new definition")),
    ],
}


class Tools:
    """Queries over a graph.  root, commits_raw, rebuild: needed by edit_code only."""

    def __init__(self, graph: M.Graph, embed=None, root: str | None = None, commits_raw: DataFrame | None = None, rebuild: Callable[[DataFrame], M.Graph] | None = None):
        self.graph, self.embed, self.root, self.commits_raw, self.rebuild = graph, embed or vector.hashed_embedding, root, commits_raw, rebuild

    def search_code_semantics(self, prompt: str, k: int = 5, exact: bool = False) -> DataFrame:
        states = self.graph.nodes[M.STATE]
        query = vector.embedded(self.embed, states.sparkSession, prompt)
        keep = (F.col("status") == M.ACTIVE) & F.col("ai_summary").isNotNull()
        return vector.knn(states, query, k, "ai_summary_vec", "node_id", keep, exact=exact).select("node_id", "function_id", "ai_summary", "code")

    def get_code_time_travel_diff(self, state_node_id: str) -> DataFrame:
        """One row with current and previous, both null for an unknown state."""
        states = self.graph.nodes[M.STATE]
        edges = self.graph.edges.where((F.col("label") == M.PREVIOUS_VERSION) & (F.col("from_id") == state_node_id))
        old = edges.agg(F.min("to_id").alias("_p")).join(states, F.col("_p") == F.col("node_id"))
        prefer = lambda d, c: d.agg(F.first(F.struct(*c)).alias("v"))  # noqa: E731  ids are unique
        now = prefer(states.where(F.col("node_id") == state_node_id), STATE_COLUMNS).withColumnRenamed("v", "current").withColumn("_one", F.lit(1))
        before = prefer(old, STATE_COLUMNS[:-1]).withColumnRenamed("v", "previous").withColumn("_one", F.lit(1))
        return now.join(before, "_one").drop("_one")

    def trace_blast_radius(self, function_identity_id: str, depth: int = 3) -> DataFrame:
        functions = self.graph.nodes[M.FUNCTION]
        anchor = functions.where(F.col("node_id") == function_identity_id).select("node_id")
        found = traverse.reach(self.graph.edge(M.CALLS), anchor, depth)
        return functions.join(found, "node_id").select("node_id", "name", "file", "hop")

    def get_temporal_vulnerability_trace(self, target_func: str, timestamp_iso: str, **options: bool) -> DataFrame:
        g = self.graph
        return traverse.temporal_trace(g.nodes[M.FUNCTION], g.edges, g.nodes[M.COMMIT], target_func, timestamp_iso, states=g.nodes[M.STATE], **options)

    def edit_code(self, file: str, function_name: str, new_code: str) -> dict:
        """Replace a function in a file under root; the change joins the log as one more commit, and the graph is rebuilt."""
        root = Path(self.root or ".").resolve()
        path = (root / file).resolve()
        if not path.is_relative_to(root):
            raise ValueError(f"path leaves the root: {file}")
        if not path.is_file():
            raise ValueError(f"file not found: {file}")
        text, replaced = replace_function(path.read_text("utf-8"), function_name, new_code)
        path.write_text(text, "utf-8")
        ingest = "skipped"
        if self.commits_raw is not None and self.rebuild is not None:
            self.commits_raw = self.commits_raw.unionByName(edit_commit(self.commits_raw, file, text, f"edit {function_name} in {file}"))
            self.graph, ingest = self.rebuild(self.commits_raw), "ok"
        return {"status": "patched", "file": file, "function_name": function_name, "lines_replaced": replaced, "ingest": ingest}

    def call(self, name: str, parameters: dict) -> Any:
        p = parameters
        if name == "search_code_semantics":
            return rows(self.search_code_semantics(p["prompt"], p.get("k", 5)))
        if name == "get_code_time_travel_diff":
            return rows(self.get_code_time_travel_diff(p["state_node_id"]))[0]
        if name == "trace_blast_radius":
            return rows(self.trace_blast_radius(p["function_identity_id"], p.get("depth", 3)).orderBy("hop", "node_id").drop("hop"))
        if name == "get_temporal_vulnerability_trace":
            return rows(self.get_temporal_vulnerability_trace(p["target_func"], p["timestamp_iso"]))
        if name == "edit_code":
            return self.edit_code(p["file"], p["function_name"], p["new_code"])
        raise LookupError(f"unknown tool: {name}")

    def dispatch(self, method: str, path: str, body: bytes | str = b"") -> tuple[int, Any]:
        """Status and JSON-ready answer of an HTTP request."""
        if method == "GET":
            return (200, MANIFEST) if path in ("/", "/manifest") else (404, {"error": "not found"})
        if method != "POST" or path != "/call":
            return 404, {"error": "not found"}
        try:
            request = json.loads(body or "{}")
            return 200, {"result": self.call(request.get("name", ""), request.get("parameters", {}))}
        except LookupError as e:
            return (404 if str(e).strip("'").startswith("unknown tool") else 500), {"error": str(e)}
        except Exception as e:  # noqa: BLE001  every failure becomes an answer
            return 500, {"error": str(e)}


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]] if df.columns else []


def edit_commit(log: DataFrame, path: str, source: str, msg: str) -> DataFrame:
    """One more commit for a log, with one file."""
    last = log.agg(F.max("commit_seq")).first()[0]
    seq = (last if last is not None else -1) + 1
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    sha = hashlib.sha1(f"{seq}\0{path}\0{source}".encode()).hexdigest()
    return log.sparkSession.createDataFrame([(seq, sha, "editor", msg, now, 0, path, source)], M.COMMITS_RAW)


def serve(tools: Tools, host: str = "127.0.0.1", port: int = 7700) -> HTTPServer:
    """An HTTP server of the tools; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, reply = tools.dispatch(method, self.path, body)
            data = json.dumps(reply).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer("GET")

        def do_POST(self) -> None:
            self.answer("POST")

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)
