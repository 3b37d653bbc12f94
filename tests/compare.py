"""Runs a registered query and its SQL side by side and compares all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "tzinfo"):
        return str(value.replace(tzinfo=None))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    expected = rows_of(sql_names, result.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(sql_names):
        return f"columns {sorted(df.columns)} against {sorted(sql_names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{a} against {b} ({sum(x != y for x, y in zip(got, expected))} rows differ)"
    return None
