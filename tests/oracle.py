"""Runs a query's SQL in DuckDB and compares it with the query's rows."""

import os

import duckdb


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def compare(df, sql, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), names)
