"""Replay of a commit log into a temporal graph, restated as joins, aggregations and windows.

commits_raw (model.COMMITS_RAW): a row per commit and changed file in replay order; a row with a null path for a commit
without files.  No state is carried from commit to commit: what a sequential replay would remember is a window or a minimum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..functions.pycode import extract_definitions
from ..sources.gitlog import python_files
from ..storage import stored
from ..workers import importable
from . import enrich
from .ordered import asof_last, chained, first_per_key, following, with_ends, with_status

COMMITS_PER_BUCKET = 1000


def order(file_seq: Column | str, seq: Column | str) -> Column:
    return F.struct(F.col("commit_seq").cast("long").alias("commit_seq"), M.col(file_seq).cast("long").alias("file_seq"), M.col(seq).cast("long").alias("seq"))


def extracted(files: DataFrame) -> DataFrame:
    """files (commit_seq, short, file_seq, path, safe, source) with the events of each file."""
    importable(files.sparkSession)
    return files.lateralJoin(extract_definitions(F.col("source").outer())).drop("source")


def edges_of(df: DataFrame, from_id, from_kind, label: str, to_id, to_kind: str, ord_: Column | str = "ord") -> DataFrame:
    lit = lambda k: F.lit(k) if isinstance(k, str) else k
    return df.select(from_id.alias("from_id"), lit(from_kind).alias("from_kind"), F.lit(label).alias("label"), to_id.alias("to_id"), lit(to_kind).alias("to_kind"), M.col(ord_).alias("ord"))


def replay(commits_raw: DataFrame, embed=None) -> M.Graph:
    """The graph of a commit log.  embed: a function from a text column to a vector column (vector.hashed_embedding by default)."""
    from .vector import hashed_embedding

    embed = embed or hashed_embedding
    raw = commits_raw.withColumns({"short": M.short_hash("hexsha"), "safe": M.safe_path("path")})
    # each file is read and parsed once: what follows goes back to these tables some twenty times
    events = stored(extracted(python_files(raw).where(F.col("source").isNotNull()).select("commit_seq", "short", "file_seq", "path", "safe", "source")), "events").withColumn("ord", order("file_seq", "seq"))
    raw = stored(raw.select("commit_seq", "hexsha", "short", "author", "msg", "timestamp", "file_seq", "path", "safe", F.col("source").isNotNull().alias("present")), "log")
    commits = raw.groupBy("commit_seq").agg(*[F.first(c).alias(c) for c in ("hexsha", "short", "author", "msg", "timestamp")])
    commits = commits.withColumn("ord", order(F.lit(-2), F.lit(0)))
    files = python_files(raw).where("present").select("commit_seq", "short", "file_seq", "path", "safe").withColumn("ord", order("file_seq", F.lit(0)))
    fid = M.file_id("safe")
    scope_id = F.when(F.col("scope").isNull(), fid).otherwise(M.class_id("safe", "scope"))
    scope_kind = F.when(F.col("scope").isNull(), F.lit(M.FILE)).otherwise(F.lit(M.CLASS))
    of = lambda event: events.where(F.col("event") == event)

    # nodes: first writer wins
    file_rows = files.select(fid.alias("node_id"), F.col("path").alias("file"), F.lit(None).cast("string").alias("external"), "ord")
    module = X.first_segment("name")
    imported = of("import").select(M.file_id(module).alias("node_id"), module.alias("file"), F.lit("true").alias("external"), "ord")
    files_all = file_rows.unionByName(imported)
    classes = of("class").select(M.class_id("safe", "name").alias("node_id"), "name", F.col("path").alias("file"), "ord")
    functions = of("function").withColumns({"function_id": M.function_id("safe", "name"), "state_id": M.state_id("safe", "name", "short")})
    summary = enrich.ingest_summary("text")
    states_all = functions.select(
        F.col("state_id").alias("node_id"), "function_id", F.col("short").alias("commit"), X.left("text", M.STORED).alias("code"), M.code_hash("text").alias("code_hash"),
        X.left(summary, M.STORED).alias("ai_summary"), "ord",
    )
    states_all = with_status(states_all, ["function_id"], ["ord"], "node_id", M.ACTIVE, M.SUPERSEDED)
    with_vector = lambda df: df.withColumn("ai_summary_vec", embed(F.col("ai_summary")))
    nodes = {
        M.COMMIT: commits.select(M.commit_id("short").alias("node_id"), F.col("hexsha").alias("hash"), "author", X.left(X.stripped("msg"), M.STORED).alias("msg"), "timestamp", F.try_to_timestamp("timestamp").alias("commit_ts"), F.lit("").alias("ai_rationale"), "ord"),
        M.FILE: first_per_key(files_all, ["node_id"]),
        M.CLASS: first_per_key(classes, ["node_id"]),
        M.FUNCTION: first_per_key(functions.select(F.col("function_id").alias("node_id"), "name", F.col("path").alias("file"), "ord"), ["node_id"]),
        M.STATE: with_vector(first_per_key(states_all, ["node_id"])),
    }
    nodes[M.COMMIT] = first_per_key(nodes[M.COMMIT], ["node_id"])

    # edges, in the order in which a replay makes them
    step = lambda k: F.struct("ord.commit_seq", "ord.file_seq", "ord.seq", F.lit(k).alias("k"))
    prior = chained(functions, ["function_id"], ["ord"], "state_id").where(F.col("previous").isNotNull())
    bucket = F.floor(F.col("commit_seq") / COMMITS_PER_BUCKET)
    calls = of("call").select(X.callee_name("text").alias("name"), "ord", M.function_id("safe", "owner").alias("caller"), bucket.alias("bucket"))
    defined = functions.select("name", "ord", F.col("function_id").alias("callee"), bucket.alias("bucket"))
    resolved = asof_last(defined, calls, "name", "ord", "callee", "bucket").where(F.col("callee").isNotNull())
    chain = following(commits.select("short", "commit_seq", "ord"), "short", ["commit_seq"], bucket).where(F.col("next_id").isNotNull())
    made = [
        edges_of(chain, M.commit_id("short"), M.COMMIT, M.NEXT_COMMIT, M.commit_id("next_id"), M.COMMIT, F.struct((F.col("commit_seq") + 1).alias("commit_seq"), F.lit(-1).cast("long").alias("file_seq"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("k"))),
        edges_of(files, M.commit_id("short"), M.COMMIT, M.CONTAINS, fid, M.FILE, step(0)),
        edges_of(of("import"), fid, M.FILE, M.IMPORTS, M.file_id(module), M.FILE, step(1)),
        edges_of(of("class"), scope_id, scope_kind, M.CONTAINS, M.class_id("safe", "name"), M.CLASS, step(2)),
        edges_of(of("base"), M.class_id("safe", "owner"), M.CLASS, M.INHERITS, M.class_id("safe", "name"), M.CLASS, step(3)),
        edges_of(functions, scope_id, scope_kind, M.CONTAINS, F.col("function_id"), M.FUNCTION, step(4)),
        edges_of(functions, F.col("function_id"), M.FUNCTION, M.HAS_STATE, F.col("state_id"), M.STATE, step(5)),
        edges_of(functions, M.commit_id("short"), M.COMMIT, M.GENERATED, F.col("state_id"), M.STATE, step(6)),
        edges_of(prior, F.col("state_id"), M.STATE, M.PREVIOUS_VERSION, F.col("previous"), M.STATE, step(7)),
        edges_of(resolved, F.col("caller"), M.FUNCTION, M.CALLS, F.col("callee"), M.FUNCTION, step(8)),
    ]
    edges_all = first_per_key(reduce(DataFrame.unionByName, made), ["from_id", "label", "to_id"])
    edges = resolved_edges(edges_all, nodes)
    failed = of("error").select("short", "path", F.col("text").alias("error"))
    return M.Graph(nodes, edges, edges_all.select(*M.EDGE_COLUMNS), states_all=with_vector(states_all), diagnostics=failed, files_all=files_all, extra={"functions_all": functions, "classes_all": classes})


def resolved_edges(edges: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """The edges whose ends both exist when the edge is stored: the nodes of a file are stored before its edges, and a skipped edge is never tried again."""
    known = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col("node_id").alias("id"), F.struct("ord.commit_seq", "ord.file_seq").alias("since")) for kind, df in nodes.items()])
    return with_ends(edges, known, F.struct("ord.commit_seq", "ord.file_seq")).select(*M.EDGE_COLUMNS)
