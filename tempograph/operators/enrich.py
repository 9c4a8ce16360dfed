"""Summaries of function states and rationales of commits."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..functions.pycode import describe
from ..workers import importable

# Summaries by function name that ingestion stores.
INGEST_SUMMARIES = {
    "create_user": "Stores a username-password pair in the in-memory users dict; validates non-empty inputs and enforces minimum password length.",
    "get_user": "Looks up and returns the stored password for a username from the in-memory dict, or None if absent.",
    "delete_user": "Removes a user entry from the in-memory dict and returns True, or False if the username was not present.",
    "list_users": "Returns a list of all currently registered usernames from the in-memory store.",
    "user_exists": "Returns True if the given username exists in the in-memory store, False otherwise.",
    "signup": "Registers a new user after validating username format and enforcing minimum password length; returns a structured JSON response.",
    "login": "Authenticates a user by verifying their password against the stored credential; returns a structured JSON success or failure response.",
    "validate_username": "Validates that a username is non-empty, at least 3 characters, and alphanumeric; raises ValidationError otherwise.",
    "logout": "Ends a user session by confirming the user exists; returns a structured response. Does not verify password.",
    "delete_account": "Permanently removes a user account after verifying credentials; calls login internally then drops the record from the store.",
}
# Summaries by function name that enrichment stores.
ENRICHED_SUMMARIES = {
    "create_user": "Stores a username→password pair in the in-memory users dict; v2 adds empty-input and min-length guards before writing.",
    "get_user": "Looks up and returns the stored password for a username from the in-memory dict, or None if absent.",
    "delete_user": "Removes a user entry from the in-memory dict and returns True, or False if the username was not present.",
    "list_users": "Returns a list of all currently registered usernames from the in-memory store.",
    "user_exists": "Returns True if the given username exists in the in-memory store, False otherwise.",
    "signup": "Registers a new user after checking for duplicates; v2 adds username format validation and returns a structured JSON response.",
    "login": "Authenticates a user by comparing the stored password; v2 raises typed exceptions and returns a structured JSON response instead of a plain string.",
    "validate_username": "Validates that a username is non-empty, at least 3 characters, and alphanumeric; raises ValidationError otherwise.",
    "logout": "Returns a success JSON response for a known user, or an error response if the username is not found; session state is not yet tracked.",
    "delete_account": "Verifies the user's password via login, then deletes the account from the store and returns a structured success or error response.",
}
NOTES = 300


def by_name(code: Column | str, summaries: dict[str, str]) -> Column:
    known = F.create_map(*map(F.lit, chain.from_iterable(summaries.items())))
    name = X.function_name(code)
    return F.when(name.isNotNull(), F.try_element_at(known, name))


def ingest_summary(code: Column | str) -> Column:
    """By the function's name, else the first line of its docstring."""
    return F.coalesce(by_name(code, INGEST_SUMMARIES), X.docstring_line(code))


def structural_summary(code: Column | str) -> Column:
    """By the function's name, else a description of its syntax tree (an Arrow-batched Python function; null-safe and pure)."""
    return F.coalesce(by_name(code, ENRICHED_SUMMARIES), describe(M.col(code)))


def rationale(msg: Column | str, summaries: Column | str) -> Column:
    """Of a commit's message and its functions' summaries, in order."""
    found = X.lines(X.stripped(msg))
    notes = F.array_join(F.filter(F.transform(F.slice(found, F.lit(2), F.size(found)), X.stripped), lambda x: x != ""), " ")
    summaries = M.col(summaries)
    parts = F.concat(
        F.array(F.concat(F.lit("Commit: "), found[0])),
        F.when(notes != "", F.array(F.concat(F.lit("Author notes: "), X.left(notes, NOTES)))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(summaries) > 0, F.concat(F.array(F.concat(F.lit("Functions touched ("), F.size(summaries).cast("string"), F.lit("):"))), F.transform(summaries, lambda s: F.concat(F.lit("  * "), s)))).otherwise(F.array().cast("array<string>")),
    )
    return X.left(F.array_join(parts, "\n"), M.STORED)


def patched(nodes: DataFrame, patch: DataFrame, prop: str, cut: int | None = M.STORED) -> DataFrame:
    """nodes with prop updated from patch (node_id, value); nodes without a patch keep theirs."""
    value = F.col("_value") if cut is None else X.left("_value", cut)
    p = patch.select(F.col("node_id").alias("_id"), F.col("value").alias("_value"))
    rest = [F.coalesce(value, F.col(c)).alias(c) if c == prop else F.col(c) for c in nodes.columns]
    return nodes.join(p, F.col("node_id") == F.col("_id"), "left").select(*rest)


def states_of_commits(graph: M.Graph) -> DataFrame:
    """commit_id, ord and all properties of the states that each commit generated: one join for all commits."""
    made = graph.edge(M.GENERATED).select(F.col("from_id").alias("commit_id"), F.col("to_id"), F.col("ord").alias("edge_ord"))
    return made.join(graph.nodes[M.STATE].drop("ord"), F.col("to_id") == F.col("node_id")).drop("to_id")


def enriched(graph: M.Graph, embed=None) -> M.Graph:
    """graph with summaries of all states, their vectors, and the commits' rationales."""
    from .vector import hashed_embedding

    embed = embed or hashed_embedding
    importable(graph.edges.sparkSession)
    states = graph.nodes[M.STATE]
    summary = F.when((F.length(F.coalesce("code", F.lit(""))) > 0), structural_summary("code"))
    patch = states.select("node_id", summary.alias("value")).where("value IS NOT NULL")
    states = patched(states, patch, "ai_summary")
    states = states.withColumn("ai_summary_vec", embed(F.col("ai_summary")))
    full = M.Graph({**graph.nodes, M.STATE: states}, graph.edges, graph.edges_all, graph.states_all, graph.diagnostics, graph.files_all, graph.extra)
    touched = states_of_commits(full).where(F.length("code") > 0)
    lists = touched.groupBy(F.col("commit_id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("edge_ord", "ai_summary"))).alias("_s"))
    commits = graph.nodes[M.COMMIT].where(F.col("node_id").startswith("commit_")).join(lists, F.col("node_id") == F.col("_c"), "left")
    summaries = F.coalesce(F.transform("_s", lambda s: s["ai_summary"]), F.array().cast("array<string>"))
    patch = commits.select("node_id", rationale("msg", summaries).alias("value"))
    full.nodes[M.COMMIT] = patched(graph.nodes[M.COMMIT], patch, "ai_rationale")
    return full
