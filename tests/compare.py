"""Compare a Spark result with its SQL twin, value by value."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value}"
    if isinstance(value, bool):
        return f"bool:{value}"
    if isinstance(value, float):
        return f"float:{value!r}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want_cols, want = canonical(names, cur.fetchall())
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = [g for g in got if g not in set(want)][:2]
        missing = [w for w in want if w not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; extra {extra} missing {missing}"
    for g, w in zip(got, want):
        if g != w:
            return f"{got_cols}: {g} != {w}"
    return None
