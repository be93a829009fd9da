"""Compare a registered query with its SQL, as DuckDB runs it on the same files."""

from __future__ import annotations

import math
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(v) -> str:
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.10g}"
    if isinstance(v, int):
        return f"{v:.10g}" if abs(v) < 2**31 else str(v)
    return str(v)


def rows(columns: list[str], found) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(normal(r[i]) for i in at) for r in found)


def same(spark, con, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    expected = con.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())
