"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(_cell(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    return cols, sorted((tuple(_cell(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account."""
    c1, a = rows_of_spark(df)
    c2, b = rows_of_duck(con, sql)
    if c1 != c2:
        return f"columns {c1} vs {c2}"
    if len(a) != len(b):
        only_a = list(set(a) - set(b))[:3]
        only_b = list(set(b) - set(a))[:3]
        return f"{len(a)} rows vs {len(b)}; only spark {only_a}; only sql {only_b}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:3]}"
    return None
