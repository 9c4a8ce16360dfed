"""Settings that are not data."""

from __future__ import annotations

from pathlib import Path


def first_value(path: str) -> str:
    """What follows `=` in the first line of a file that has one; empty without such a line or file.  For secrets: never log it."""
    try:
        lines = Path(path).read_text("utf-8").splitlines()
    except OSError:
        return ""
    return next((x.split("=", 1)[1].strip().strip("\"'") for x in lines if "=" in x), "")
