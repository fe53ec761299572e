"""Runs a query and its SQL on the same tables and compares them as multisets."""

import datetime
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def rows_of_sql(sql, d):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "as_tuple"):
        return round(float(v), 5) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    return v


def compare(df, sql, d):
    names, want = rows_of_sql(sql, d)
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    got = sorted((tuple(norm(r[n]) for n in sorted(names)) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[i]) for i in order) for r in want), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3]
    return len(got)
