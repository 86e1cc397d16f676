"""Side-by-side run of a query on Spark and of its SQL on DuckDB, as sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{round(v, 6) + 0.0:.6f}"
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(_plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())


def differences(df, sql: str, folder: str) -> str:
    """Empty if both agree, else what differs."""
    a, b = spark_rows(df), sql_rows(sql, folder)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] == b[1]:
        return ""
    from collections import Counter

    left, right = Counter(a[1]) - Counter(b[1]), Counter(b[1]) - Counter(a[1])
    return f"rows {len(a[1])} and {len(b[1])}; only Spark {sum(left.values())}: {list(left)[:6]}; only SQL {sum(right.values())}: {list(right)[:6]}"
