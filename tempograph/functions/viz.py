"""Look-ups of the explorer: colours, sizes and forces by kind, and its metadata panel."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import col
from .text import ellipsis

# Fixed values of the explorer.
KIND_COLOR = {
    "Repo": "#2ea043", "File": "#57ab5a", "Symbol": "#4493f8", "CodeRegion": "#79c0ff", "FileVersion": "#a5d6ff", "SymbolVersion": "#cae8ff", "CodeRegionVersion": "#ddf4ff",
    "Commit": "#e3b341", "Hunk": "#d29922", "WorkWindow": "#f0883e", "UserIntent": "#ffa657", "AgentAction": "#ffb86c", "ToolObservation": "#ffd700", "ReasoningFrame": "#ff79c6",
    "RelationOccurrence": "#c9d1d9", "DocSection": "#8b949e", "DocString": "#6e7681", "HarnessCard": "#bc8cff", "ExternalAmoRef": "#484f58", "Decision": "#80dec6", "Bug": "#ff7b72",
    "Fix": "#7ee787", "TestRun": "#58a6ff",
}
EDGE_COLOR = {
    "CONTAINS": "#2ea043", "DEFINES": "#4493f8", "IMPORTS": "#57ab5a", "CALLS": "#a371f7", "CHANGED_IN": "#e3b341", "MAPS_TO_SYMBOL": "#79c0ff", "MAPS_TO_CODE_REGION": "#a5d6ff",
    "CO_CHANGED_WITH": "#f0883e", "MOTIVATED_BY": "#ffa657", "VALIDATED_BY": "#7ee787", "RENAMED_TO": "#ff7b72", "MOVED_TO": "#ffd700", "DOCUMENTS_FILE": "#8b949e",
    "DOCUMENTS_SYMBOL": "#6e7681", "MENTIONS_FILE": "#c9d1d9", "MENTIONS_SYMBOL": "#c9d1d9", "SUPPORTS_CARD": "#bc8cff", "IMPORTED_FROM_AMO": "#484f58", "DERIVED_FROM_WORK_WINDOW": "#ff79c6",
}
KIND_DEFAULT, EDGE_DEFAULT = "#484f58", "#30363d"
RADIUS = {"Repo": 14, "Commit": 9, "WorkWindow": 9, "File": 8, "DocSection": 8, "DocString": 8, "Symbol": 7, "CodeRegion": 7, "Hunk": 5}
STRENGTH = {"CONTAINS": 0.7, "DEFINES": 0.7, "IMPORTS": 0.4, "CALLS": 0.4}
DISTANCE = {"CONTAINS": 55, "DEFINES": 70, "IMPORTS": 70}


def lookup(c: Column | str, values: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), col(c)), F.lit(default))


def kind_color(c: Column | str) -> Column:
    return lookup(c, KIND_COLOR, KIND_DEFAULT)


def edge_color(c: Column | str) -> Column:
    return lookup(c, EDGE_COLOR, EDGE_DEFAULT)


def radius(c: Column | str) -> Column:
    return lookup(c, RADIUS, 6)


def link_strength(c: Column | str) -> Column:
    return lookup(c, STRENGTH, 0.2)


def link_distance(c: Column | str) -> Column:
    return lookup(c, DISTANCE, 100)


def stroke_width(weight: Column | str) -> Column:
    return F.greatest(F.lit(0.5), F.coalesce(F.nullif(col(weight).cast("double"), F.lit(0.0)), F.lit(1.0)))


def metadata_rows(metadata: Column | str, n: int = 8, width: int = 80) -> Column:
    """The first n entries of a map of strings, values cut."""
    return F.transform(F.slice(F.map_entries(col(metadata)), 1, n), lambda e: F.struct(e["key"].alias("key"), ellipsis(e["value"], width).alias("value")))


def without_keys(metadata: Column | str, *keys: str) -> Column:
    return F.map_filter(col(metadata), lambda k, v: ~k.isin(*keys))
