"""Spark rows against DuckDB rows of the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "asDict"):
        return str({k: plain(x) for k, x in v.asDict().items()})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def assert_same(df, sql: str, sf_dir: str) -> None:
    assert spark_rows(df) == duck_rows(sql, sf_dir)
