"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def plain(x):
    return f"{x:.6f}" if isinstance(x, float) else x


def both(spark, folder: str, query, sql: str):
    """(columns, sorted rows) of either side."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = connection(folder).execute(sql)
    names = [d[0] for d in r.description]
    at = [names.index(c) for c in cols] if sorted(names) == cols else list(range(len(names)))
    theirs = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
    return (cols, ours), (sorted(names), theirs)
