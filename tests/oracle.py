"""Runs a query in Spark and its SQL in DuckDB over the same files, and compares rows without order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v: object) -> object:
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def compare(query, sql: str, spark, sf_dir: str) -> tuple[list[str], int]:
    """(differences, rows)."""
    df = query(spark, sf_dir)
    res = views(sf_dir).execute(sql)
    names = [c[0] for c in res.description]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"], 0
    cols = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    kinds = {c: t for c, t in df.dtypes}
    out = [f"{len(mine)} rows and {len(theirs)}"] if len(mine) != len(theirs) else []
    out += [f"{cols}: {a} and {b}" for a, b in zip(mine, theirs, strict=False) if a != b][:3]
    sql_kinds = {c[0]: str(c[1]) for c in res.description}
    for c in cols:
        k = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(kinds[c])
        if k and sql_kinds[c] != k:
            out.append(f"type of {c}: {kinds[c]} and {sql_kinds[c]}")
    return out, len(mine)
