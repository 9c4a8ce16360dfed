"""Traversals of an edge relation (from_id, label, to_id, ...) as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept, scratch, stored

def out(rows: DataFrame, edges: DataFrame, label: str | None = None, key: str = "node_id", to: str = "next_id") -> DataFrame:
    """rows joined with the nodes that their key points to (one row per edge: a multiset of paths)."""
    return _hop(rows, edges, label, key, to, "from_id", "to_id")


def in_(rows: DataFrame, edges: DataFrame, label: str | None = None, key: str = "node_id", to: str = "next_id") -> DataFrame:
    """rows joined with the nodes that point to their key."""
    return _hop(rows, edges, label, key, to, "to_id", "from_id")


def _hop(rows: DataFrame, edges: DataFrame, label: str | None, key: str, to: str, here: str, there: str) -> DataFrame:
    edges = edges if label is None else edges.where(F.col("label") == label)
    e = edges.select(F.col(here).alias("_here"), F.col(there).alias(to))
    return rows.join(e, rows[key] == e["_here"]).drop("_here")


def reach(edges: DataFrame, anchors: DataFrame, depth: int, reverse: bool = True, strategy: str = "frontier") -> DataFrame:
    """node_id and hop (the fewest, from 1 to depth) of the nodes reachable from any anchor, without the anchors themselves.

    strategy: `frontier` (breadth-first, each node is expanded once, so cycles, hubs and dense graphs cost no more than their
    edges), or, for small graphs, `cte` (a recursive query, which enumerates walks and stops with an error beyond
    spark.sql.cteRecursionRowLimit of them) and `unrolled` (depth joins of nodes that are distinct after each).
    """
    here, there = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    steps = edges.select(F.col(here).alias("src"), F.col(there).alias("dst")).distinct()
    start = anchors.select(F.col(anchors.columns[0]).cast(steps.schema["dst"].dataType).alias("node_id")).distinct()
    found = {"cte": _cte, "frontier": _frontier, "unrolled": _unrolled}[strategy](steps, start, depth)
    found = found.groupBy("node_id").agg(F.min("hop").cast("int").alias("hop"))
    return found.join(start, "node_id", "left_anti")


def _cte(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    return steps.sparkSession.sql(
        """
        WITH RECURSIVE reached (node_id, hop) AS (
            SELECT node_id, 0 FROM {start}
            UNION ALL
            SELECT s.dst, r.hop + 1 FROM reached r JOIN {steps} s ON s.src = r.node_id WHERE r.hop < :depth
        )
        SELECT node_id, hop FROM reached WHERE hop > 0
        """,
        args={"depth": depth}, start=start, steps=steps,
    )


def _frontier(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Hop by hop: the neighbours of the newest nodes, once each, without those reached before; a stored table for each hop."""
    with scratch(steps.sparkSession):
        visited = newest = stored(start.withColumn("hop", F.lit(0)), "reach_0")
        for hop in range(1, depth + 1):
            near = newest.join(steps, newest["node_id"] == steps["src"]).select(F.col("dst").alias("node_id")).distinct()
            newest = stored(near.join(visited.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop)), f"reach_{hop}")
            if newest.isEmpty():
                break
            visited = visited.unionByName(newest)
        return kept(visited.where("hop > 0"), "reached")


def _unrolled(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    level, levels = start, []
    for hop in range(1, depth + 1):
        level = level.join(steps, level["node_id"] == steps["src"]).select(F.col("dst").alias("node_id")).distinct()
        levels.append(level.withColumn("hop", F.lit(hop)))
    return reduce(DataFrame.unionByName, levels)


def walks(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node_id, hop of every walk of 1 to depth steps, repeats kept.  steps: (src, dst)."""
    level, levels = start, []
    for hop in range(1, depth + 1):
        level = level.join(steps, level["node_id"] == steps["src"]).select(F.col("dst").alias("node_id"))
        levels.append(level.withColumn("hop", F.lit(hop)))
    return reduce(DataFrame.unionByName, levels)


def temporal_trace(functions: DataFrame, edges: DataFrame, commits: DataFrame, name: str, before: str, distinct: bool = False, detailed: bool = False, instant: bool = False, states: DataFrame | None = None) -> DataFrame:
    """Commits before a time that generated states of the callers of a function: callers <-CALLS-, -HAS_STATE->, <-GENERATED-.

    A row per path.  distinct: each commit once.  detailed: also the caller, its state, and the state's summary and status.
    instant: compare points in time instead of ISO strings.
    """
    target = functions.where(F.col("name") == name).select("node_id")
    rows = in_(target, edges, "CALLS", to="caller_id")
    rows = out(rows, edges, "HAS_STATE", key="caller_id", to="state_id")
    rows = in_(rows, edges, "GENERATED", key="state_id", to="commit_id").drop("node_id")
    early = F.to_timestamp("timestamp") < F.to_timestamp(F.lit(before)) if instant else F.col("timestamp") < before
    rows = rows.join(commits.where(early).select(F.col("node_id").alias("commit_id"), "hash", "timestamp", "msg"), "commit_id")
    columns = [F.col("commit_id").alias("node_id"), "hash", "timestamp", "msg"]
    if detailed:
        rows = rows.join(functions.select(F.col("node_id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
        if states is not None:
            rows = rows.join(states.select(F.col("node_id").alias("state_id"), "ai_summary", F.col("status").alias("state_status")), "state_id", "left")
            columns += ["ai_summary", "state_status"]
        columns += ["caller", F.col("caller_id").alias("caller_node_id"), "state_id", F.col("hash").alias("commit_hash")]
    rows = rows.select(*columns)
    return rows.distinct() if distinct else rows


def version_diff(states: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """current and previous (structs of columns; previous null for a first version) of each state; the smallest id if there are several."""
    now = states.select("node_id", F.struct(*columns).alias("current"))
    back = edges.where(F.col("label") == "PREVIOUS_VERSION").groupBy(F.col("from_id").alias("_f")).agg(F.min("to_id").alias("_t"))
    old = states.select(F.col("node_id").alias("_p"), F.struct(*[c for c in columns if c != "status"]).alias("previous"))
    return now.join(back, F.col("node_id") == F.col("_f"), "left").join(old, F.col("_t") == F.col("_p"), "left").select("node_id", "current", "previous")


def call_chains(functions: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """caller and chain (`c <- b <- a`) for each direct caller b of a node, followed by all of b's callers, names sorted."""
    names = functions.select("node_id", "name")
    anchor = names.where(F.col("node_id") == node_id)
    first = in_(anchor, edges, "CALLS", to="b").join(names.select(F.col("node_id").alias("b"), F.col("name").alias("b_name")), "b")
    second = in_(first.select("b"), edges, "CALLS", key="b", to="c").join(names.select(F.col("node_id").alias("c"), F.col("name").alias("c_name")), "c")
    tail = second.groupBy("b").agg(F.array_sort(F.collect_list("c_name")).alias("tail"))
    full = first.join(tail, "b", "left")
    return full.select(F.col("b").alias("caller"), F.array_join(F.concat(F.array("name", "b_name"), F.coalesce("tail", F.array().cast("array<string>"))), " <- ").alias("chain"))


def callers_with_summary(functions: DataFrame, edges: DataFrame, states: DataFrame, node_id: str) -> DataFrame:
    """caller, name and the summary of its active state (empty if there is none) of the direct callers."""
    anchor = functions.where(F.col("node_id") == node_id).select("node_id")
    rows = in_(anchor, edges, "CALLS", to="caller").select("caller").distinct()
    rows = rows.join(functions.select(F.col("node_id").alias("caller"), "name"), "caller")
    active = edges.where(F.col("label") == "HAS_STATE").join(states.where(F.col("status") == "active").select(F.col("node_id").alias("to_id"), "ai_summary"), "to_id")
    active = active.groupBy(F.col("from_id").alias("_f")).agg(F.min_by("ai_summary", "to_id").alias("ai_summary"))
    return rows.join(active, F.col("caller") == F.col("_f"), "left").select("caller", "name", F.coalesce("ai_summary", F.lit("")).alias("ai_summary"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (source, target, kind) whose ends are both among nodes (id)."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    return edges.join(ids, edges["source"] == ids["_id"], "left_semi").join(ids, edges["target"] == ids["_id"], "left_semi")


def connected(nodes: DataFrame, edges: DataFrame, isolated: bool = False) -> DataFrame:
    """The nodes with an edge, or those without."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes.join(ends, "id", "left_anti" if isolated else "left_semi")


def viz_filter(nodes: DataFrame, kind: str | None = None, status: str | None = None, query: str | None = None) -> DataFrame:
    """The explorer's filters; an empty one passes all."""
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
    keep: Column = F.lit(True)
    if kind:
        keep = keep & (F.col("kind") == kind)
    if status:
        keep = keep & (F.col("status") == status)
    if query:
        keep = keep & (has("label") | has("summary") | has("kind"))
    return nodes.where(keep)


def neighbours(nodes: DataFrame, edges: DataFrame, node_id) -> DataFrame:
    """direction, edge_kind, id, kind, label of a node's neighbours; unknown ones are left out."""
    info = nodes.select("id", "kind", "label")
    side = lambda a, b, sign: edges.where(F.col(a) == node_id).select(F.lit(sign).alias("direction"), F.col("kind").alias("edge_kind"), F.col(b).alias("id"))
    return side("source", "target", "→").unionByName(side("target", "source", "←")).join(info, "id").select("direction", "edge_kind", "id", "kind", "label")
