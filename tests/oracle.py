"""Runs a query and its DuckDB statement on the same tables and compares them."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def compare(df, con, sql: str) -> str | None:
    """None, or what differs."""
    rel = con.sql(sql)
    want_cols, got_cols = sorted(rel.columns), sorted(df.columns)
    if want_cols != got_cols:
        return f"columns {got_cols} against {want_cols}"
    want = sorted((tuple(str(plain(r[rel.columns.index(c)])) for c in want_cols) for r in rel.fetchall()))
    got = sorted(tuple(str(plain(r[c])) for c in got_cols) for r in df.collect())
    if want != got:
        odd = [x for x in zip(got, want, strict=False) if x[0] != x[1]][:2]
        return f"{len(got)} against {len(want)} rows; {odd}"
    return None if got else "no rows"
