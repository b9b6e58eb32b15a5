"""Rows of a query and of its SQL twin in one comparable form."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return round(v, 6)
    return str(v)


def rows_of(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    names = sorted(found)
    at = [found.index(c) for c in names]
    return names, sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
