"""Compare a query's rows with the rows DuckDB returns for its SQL."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return ("f", repr(value))
        return ("f", repr(value))
    if isinstance(value, int):
        return ("i", value)
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns, row count and every value agree; else what differs."""
    rel = con.sql(sql)
    names, want = list(rel.columns), rel.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    types = {n: str(t) for n, t in zip(names, rel.types)}
    odd = {n: t for n, t in types.items() if t.startswith(("HUGEINT", "DECIMAL", "FLOAT"))}
    if odd:
        return f"types of the SQL: {odd}"
    kinds = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    got_types = dict(spark_df.dtypes)
    wrong = {n: (got_types[n], t) for n, t in types.items() if kinds.get(t, t) != got_types[n]}
    got = [tuple(r) for r in spark_df.collect()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = _rows(spark_df.columns, got), _rows(names, want)
    if a != b:
        left, right = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"{sum((a - b).values())} of {len(got)} rows differ: {left} against {right}; columns {sorted(names)}"
    return f"types {wrong}" if wrong else None
