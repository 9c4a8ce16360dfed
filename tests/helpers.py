from __future__ import annotations

from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value that compares alike from both engines."""
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return tuple(sorted(v.items())) if isinstance(v, dict) else v


def multiset(rows, columns) -> list:
    order = sorted(columns)
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
