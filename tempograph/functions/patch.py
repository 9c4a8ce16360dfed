"""Replacing one function in Python source text."""

from __future__ import annotations

import ast
import textwrap
from collections import deque

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: str, what: str) -> ast.Module:
    try:
        return ast.parse(text)
    except SyntaxError as e:
        raise ValueError(f"{what}: {e}") from e


def position(tree: ast.Module, name: str) -> tuple[int, int, int]:
    """First line, last line and column of the outermost function of this name (level by level, in the order of the text)."""
    level = deque([tree])
    while level:
        node = level.popleft()
        if type(node) is ast.FunctionDef and node.name == name:
            return node.lineno, node.end_lineno, node.col_offset
        level.extend(ast.iter_child_nodes(node))
    raise ValueError(f"function not found: {name}")


def replace_function(source: str, name: str, new_code: str) -> tuple[str, str]:
    """source with the first function of this name (not async; outermost first) replaced, and the replaced lines as `a–b`.

    Decorators stay; the new code takes the old one's indentation; a line end at the end is ensured.
    """
    parsed(new_code, "new code has a syntax error")
    first, last, column = position(parsed(source, "existing file can't be parsed"), name)
    text = source.splitlines(keepends=True)
    margin = text[first - 1].encode()[:column].decode()
    block = textwrap.indent(new_code.lstrip(" \t"), margin, lambda line: not line.isspace())
    text[first - 1 : last] = [block if block.endswith("\n") else block + "\n"]
    return "".join(text), f"{first}–{last}"


def patched(source: Column, name: Column, new_code: Column) -> Column:
    """replace_function as an Arrow-batched column function: a struct (text, lines_replaced, error)."""

    def one(text: str | None, function: str | None, code: str | None) -> dict:
        try:
            new, lines = replace_function(text or "", function or "", code or "")
        except ValueError as e:
            return {"text": None, "lines_replaced": None, "error": str(e)}
        return {"text": new, "lines_replaced": lines, "error": None}

    return F.udf(one, "text string, lines_replaced string, error string", useArrow=True)(source, name, new_code)
