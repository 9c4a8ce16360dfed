"""String expressions with the semantics of the scripting languages that wrote the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EXCERPT, LABEL, SUMMARY, col, replaced

#: what ends a line for str.splitlines
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# Fixed value: what names a function.
FUNCTION_NAME = r"(?U)^\s*(?:async\s+)?def\s+(\w+)"
# Fixed value: the types of the public Conventional Commits convention.
CONVENTIONAL = r"(?i)^(feat|fix|refactor|chore|docs|test|perf|style|ci|build|revert)(\([^)]+\))?(!)?:\s*(.+)"


def stripped(c: Column | str) -> Column:
    """All white space at both ends goes, not blanks only."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def first_line(c: Column | str) -> Column:
    """Up to the first line feed."""
    return F.split(col(c), "\n")[0]


def lines(c: Column | str) -> Column:
    """All lines by any line end; a line end at the very end starts no line."""
    found = F.split(col(c), LINE_END)
    return F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def first_full(*cols: Column | str) -> Column:
    """The first that is neither null nor empty, else the last one."""
    cols = [col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def left(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def ellipsis(c: Column | str, n: int) -> Column:
    """At most n characters, with a sign where something is cut."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(left(c, n), F.lit("…"))).otherwise(c)


def html_escaped(c: Column | str) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda x, p: replaced(x, *p), pairs, F.coalesce(col(c).cast("string"), F.lit("")))


def callee_name(c: Column | str) -> Column:
    """`a.b(x).c` -> b: what is before the first bracket, after the last dot."""
    return F.substring_index(F.substring_index(col(c), "(", 1), ".", -1)


def first_segment(c: Column | str) -> Column:
    return F.substring_index(col(c), ".", 1)


def function_name(code: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(code), FUNCTION_NAME, 1), F.lit(""))


def docstring_line(code: Column | str) -> Column:
    """First line of the first triple-quoted text; empty without one."""
    found = F.regexp_extract(col(code), r'(?s)"""(.+?)"""', 1)
    return F.coalesce(F.split(stripped(found), LINE_END)[0], F.lit(""))


def conventional_commit(msg: Column | str) -> Column:
    """struct(type, scope, breaking, subject) of a conventional commit message; null if it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(col(msg), CONVENTIONAL, k), F.lit(""))
    out = F.struct(F.lower(part(1)).alias("type"), part(2).alias("scope"), part(3).isNotNull().alias("breaking"), part(4).alias("subject"))
    return F.when(part(1).isNotNull(), out)


def distinct_sorted(c: Column | str) -> Column:
    """Sorted distinct values without the empty string."""
    return F.array_sort(F.array_distinct(F.filter(col(c), lambda x: x != "")))


def viz_label(name, msg, file, node_id) -> Column:
    return left(first_full(name, first_line(msg), file, node_id), LABEL)


def viz_summary(ai_summary, ai_rationale, code) -> Column:
    """Of the export that ingestion writes."""
    return first_full(ai_summary, ai_rationale, F.coalesce(left(code, EXCERPT), F.lit("")))


def rebuilt_label(name, msg, file, node_id) -> Column:
    """Of the export rebuilt from the payload: lines by any line end."""
    return left(first_full(name, F.split(col(msg), LINE_END)[0], file, node_id), LABEL)


def rebuilt_summary(ai_rationale, ai_summary, code) -> Column:
    return left(first_full(ai_rationale, ai_summary, F.coalesce(left(code, EXCERPT), F.lit(""))), SUMMARY)
