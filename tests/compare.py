"""Run a query and its SQL side by side and say how they differ."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def _cell(x):
    if x is None:
        return "null"
    if isinstance(x, float):
        return "null" if math.isnan(x) else repr(x)
    return str(x)


def _rows(table):
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns))


def difference(df, con, sql: str) -> str | None:
    """None if schema and rows agree, else a short account."""
    ours = df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    a_names, a = _rows(ours)
    b_names, b = _rows(theirs)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    types = [
        (n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in a_names
    ]
    odd = [t for t in types if t[1] != t[2]]
    if odd:
        return f"types {odd}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}: {sorted(set(a) ^ set(b))[:4]}"
    if a != b:
        return f"values {sorted(set(a) - set(b))[:2]} != {sorted(set(b) - set(a))[:2]}"
    return None if len(a) else "no rows"
