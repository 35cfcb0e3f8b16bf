"""Runs a query and its SQL, and compares their rows whatever the order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in data)), sorted(columns)


def compare(spark, con, folder: str, query, sql: str) -> str:
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    out = con.execute(sql)
    want = rows([c[0] for c in out.description], out.fetchall())
    if got == want:
        return ""
    if got[1] != want[1]:
        return f"columns {got[1]} {want[1]}"
    extra = [r for r in got[0] if r not in set(want[0])][:3]
    missing = [r for r in want[0] if r not in set(got[0])][:3]
    return f"rows {len(got[0])} {len(want[0])}; only here {extra}; only there {missing}"
