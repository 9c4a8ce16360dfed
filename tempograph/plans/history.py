"""A commit log made of the driver's conversations, and SQL for the graph that its replay must give.

A turn number is a commit, a conversation a file of each commit that has such a turn, and a turn's text is rendered as source
text: an import by its role, a class with a method `say`, and a function named after the text's length that calls one
named after the turn.  All files share the forty function names, so calls are resolved across files and commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from . import adapters as A

NAMES = 40
#: the source text of a turn; the places of %s: role, conversation, name, name, checksum, called name
SOURCE = 'import %s.tools\n\nclass Talk%s(Base):\n    def say(self, x):\n        return f%s(x)\n\ndef f%s(x):\n    """%s"""\n    f%s(x)\n    return len(x)\n'

TURNS = f"""t AS (SELECT conv_id AS c, turn, role, 'talk/' || (conv_id % 7) || '/c' || conv_id || '.py' AS path, 'talk_' || (conv_id % 7) || '_c' || conv_id AS safe,
    sha1('turn ' || turn) AS sha, left(sha1('turn ' || turn), 7) AS short, length(text) % {NAMES} AS k, (conv_id * 7 + turn) % {NAMES} AS m, sha1(text) AS mark FROM conversations)"""
STATES = """d AS (SELECT *, 'say' AS name, 1 AS seq, 'def say(self, x):' || chr(10) || '        return f' || k || '(x)' AS code, 'f' || k AS callee FROM t
    UNION ALL SELECT *, 'f' || k, 2, 'def f' || k || '(x):' || chr(10) || '    \"\"\"' || mark || '\"\"\"' || chr(10) || '    f' || m || '(x)' || chr(10) || '    return len(x)', 'f' || m FROM t),
  s AS (SELECT *, 'func_' || safe || '_' || name AS f, 'state_' || safe || '_' || name || '_' || short AS id, substring(sha1(code), 1, 12) AS code_hash,
    lag('state_' || safe || '_' || name || '_' || short) OVER w AS previous, row_number() OVER w AS version, lead(1) OVER w IS NULL AS head FROM d WINDOW w AS (PARTITION BY safe, name ORDER BY turn))"""
#: the definition that a call meets: the last of its name up to the calling function, in the order of commits, files and lines
MET = """u AS (SELECT callee AS name, f AS caller, turn, c, seq, NULL AS def FROM s UNION ALL SELECT name, NULL, turn, c, seq - 0.5, f FROM s),
  m AS (SELECT caller, last_value(def IGNORE NULLS) OVER (PARTITION BY name ORDER BY turn, c, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS callee FROM u)"""

NODES_SQL = f"""WITH {TURNS}, {STATES}
    SELECT DISTINCT 'Commit' AS kind, 'commit_' || short AS node_id, NULL AS name, NULL AS file, NULL AS status, NULL AS code_hash FROM t
    UNION ALL SELECT DISTINCT 'FileIdentity', 'file_' || safe, NULL, path, NULL, NULL FROM t
    UNION ALL SELECT DISTINCT 'FileIdentity', 'file_' || role, NULL, role, NULL, NULL FROM t
    UNION ALL SELECT DISTINCT 'ClassIdentity', 'class_' || safe || '_Talk' || c, 'Talk' || c, path, NULL, NULL FROM t
    UNION ALL SELECT DISTINCT 'FunctionIdentity', f, name, path, NULL, NULL FROM s
    UNION ALL SELECT 'FunctionState', id, NULL, NULL, CASE WHEN head THEN 'active' ELSE 'superseded' END, code_hash FROM s"""
KEPT_SQL = f"""WITH {TURNS}, {STATES}, {MET}, q AS (SELECT DISTINCT turn, short FROM t), e AS (
    SELECT 'commit_' || short AS from_id, 'Commit' AS from_kind, 'NEXT_COMMIT' AS label, 'commit_' || lead(short) OVER (ORDER BY turn) AS to_id, 'Commit' AS to_kind FROM q
    UNION ALL SELECT 'commit_' || short, 'Commit', 'CONTAINS', 'file_' || safe, 'FileIdentity' FROM t
    UNION ALL SELECT 'file_' || safe, 'FileIdentity', 'IMPORTS', 'file_' || role, 'FileIdentity' FROM t
    UNION ALL SELECT 'file_' || safe, 'FileIdentity', 'CONTAINS', 'class_' || safe || '_Talk' || c, 'ClassIdentity' FROM t
    UNION ALL SELECT CASE seq WHEN 1 THEN 'class_' || safe || '_Talk' || c ELSE 'file_' || safe END, CASE seq WHEN 1 THEN 'ClassIdentity' ELSE 'FileIdentity' END, 'CONTAINS', f, 'FunctionIdentity' FROM s
    UNION ALL SELECT f, 'FunctionIdentity', 'HAS_STATE', id, 'FunctionState' FROM s
    UNION ALL SELECT 'commit_' || short, 'Commit', 'GENERATED', id, 'FunctionState' FROM s
    UNION ALL SELECT id, 'FunctionState', 'PREVIOUS_VERSION', previous, 'FunctionState' FROM s
    UNION ALL SELECT caller, 'FunctionIdentity', 'CALLS', callee, 'FunctionIdentity' FROM m WHERE caller IS NOT NULL)
    SELECT DISTINCT * FROM e WHERE to_id IS NOT NULL"""
EDGES_SQL = KEPT_SQL + " UNION ALL SELECT DISTINCT 'class_' || safe || '_Talk' || c, 'ClassIdentity', 'INHERITS', 'class_' || safe || '_Base', 'ClassIdentity' FROM t"
SUMMARY_SQL = f"""WITH {TURNS}, {STATES} SELECT id AS node_id, CASE WHEN head THEN 'active' ELSE 'superseded' END AS status,
    '`' || name || '` — accepts (x); calls ' || callee || CASE seq WHEN 1 THEN '' ELSE ', len' END || '; returns a value' AS ai_summary FROM s"""
PATCH_SQL = f"""WITH {TURNS} SELECT path AS file, turn, '7–10' AS lines_replaced,
    'import ' || role || '.tools' || chr(10) || chr(10) || 'class Talk' || c || '(Base):' || chr(10) || '    def say(self, x):' || chr(10) || '        return f' || k || '(x)' || chr(10) || chr(10)
    || 'def f' || k || '(x):' || chr(10) || '    return x' || chr(10) AS text FROM t"""


def rendered(text: Column, conv: Column, turn: Column, role: Column) -> Column:
    name, called = F.length(text) % NAMES, (conv * 7 + turn) % NAMES
    return F.format_string(SOURCE, role, conv.cast("string"), name.cast("string"), name.cast("string"), F.sha1(text), called.cast("string"))


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    text, conv, turn, role = (F.col(k) for k in ("text", "conv_id", "turn", "role"))
    number = turn.cast("string")
    return c.select(
        turn.alias("commit_seq"), F.sha1(F.concat(F.lit("turn "), number)).alias("hexsha"), F.lit("ann").alias("author"), F.concat(F.lit("feat: turn "), number).alias("msg"),
        F.date_format(F.timestamp_seconds(turn * 3600), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), conv.alias("file_seq"),
        F.concat(F.lit("talk/"), (conv % 7).cast("string"), F.lit("/c"), conv.cast("string"), F.lit(".py")).alias("path"), rendered(text, conv, turn, role).alias("source"),
    ).select(*M.COMMITS_RAW.names)


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, turn, source, function, new code: the function named after the text's length is to be replaced."""
    log = commit_log(spark, sf_dir)
    name = F.regexp_extract("source", r"(?m)^def (\w+)", 1)
    return log.select(F.col("path").alias("file"), F.col("commit_seq").alias("turn"), "source", name.alias("name"), F.concat(F.lit("def "), name, F.lit("(x):\n    return x\n")).alias("new_code"))
