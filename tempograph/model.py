"""The graph's relations, kinds, labels and id expressions.

nodes: one DataFrame per kind; edges: (from_id, from_kind, label, to_id, to_kind, ord).
ord = struct(commit_seq, file_seq, seq) is the replay order that every "first" and "last" below refers to.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT, FILE, CLASS, FUNCTION, STATE = "Commit", "FileIdentity", "ClassIdentity", "FunctionIdentity", "FunctionState"
KINDS = (COMMIT, FILE, CLASS, FUNCTION, STATE)
CONTAINS, IMPORTS, INHERITS, HAS_STATE, GENERATED = "CONTAINS", "IMPORTS", "INHERITS", "HAS_STATE", "GENERATED"
PREVIOUS_VERSION, CALLS, NEXT_COMMIT = "PREVIOUS_VERSION", "CALLS", "NEXT_COMMIT"
ACTIVE, SUPERSEDED = "active", "superseded"
#: longest stored string, embedded text, label, code excerpt and summary
STORED, EMBEDDED, LABEL, EXCERPT, SUMMARY = 4000, 2000, 60, 200, 400

COMMITS_RAW = T.StructType([
    T.StructField("commit_seq", T.LongType()), T.StructField("hexsha", T.StringType()), T.StructField("author", T.StringType()), T.StructField("msg", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("file_seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("source", T.StringType()),
])
EDGE_COLUMNS = ("from_id", "from_kind", "label", "to_id", "to_kind", "ord")


@dataclass
class Graph:
    """nodes: kind -> typed DataFrame with node_id; edges: resolved edges; edges_all: also those whose ends were missing."""

    nodes: dict[str, DataFrame]
    edges: DataFrame
    edges_all: DataFrame
    states_all: DataFrame | None = None
    diagnostics: DataFrame | None = None
    files_all: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def edge(self, label: str) -> DataFrame:
        return self.edges.where(F.col("label") == label)

    def nodes_all(self) -> DataFrame:
        """kind, node_id and all other properties as a map of strings."""
        out = None
        for kind, df in self.nodes.items():
            props = [c for c in df.columns if c not in ("node_id", "ord")]
            text = lambda c, d=df: F.to_json(c) if isinstance(d.schema[c].dataType, (T.ArrayType, T.StructType)) else F.col(c).cast("string")
            pairs = F.map_from_arrays(F.array(*map(F.lit, props)), F.array(*map(text, props)))
            part = df.select(F.lit(kind).alias("kind"), "node_id", F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("props"))
            out = part if out is None else out.unionByName(part)
        return out


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replaced(c: Column | str, old: str, new: str) -> Column:
    return F.replace(col(c), F.lit(old), F.lit(new))


def safe_path(path: Column | str) -> Column:
    """Path separators become underscores; `.py` goes, wherever it is."""
    return replaced(replaced(replaced(path, "/", "_"), "\\", "_"), ".py", "")


def short_hash(hexsha: Column | str) -> Column:
    return F.substring(col(hexsha), 1, 7)


def commit_id(short: Column | str) -> Column:
    return F.concat(F.lit("commit_"), col(short))


def file_id(safe: Column | str) -> Column:
    return F.concat(F.lit("file_"), col(safe))


def class_id(safe: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("class_"), col(safe), F.lit("_"), col(name))


def function_id(safe: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("func_"), col(safe), F.lit("_"), col(name))


def state_id(safe: Column | str, name: Column | str, short: Column | str) -> Column:
    return F.concat(F.lit("state_"), col(safe), F.lit("_"), col(name), F.lit("_"), col(short))


def code_hash(code: Column | str) -> Column:
    return F.substring(F.sha1(col(code)), 1, 12)


def unique_ids(df: DataFrame) -> bool:
    """Whether node_id is a key (the storage engine's uniqueness index)."""
    return df.groupBy("node_id").count().where("count > 1").limit(1).count() == 0
