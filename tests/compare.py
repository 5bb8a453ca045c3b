"""Compare a query with its SQL on DuckDB: same columns, same rows in any order."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return v


def oracle(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{src}'")
    rel = con.sql(sql)
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


def result(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())


def assert_same(df, sf_dir, sql):
    want_cols, want = oracle(sf_dir, sql)
    cols, got = result(df)
    assert cols == want_cols
    assert sum(got.values()) == sum(want.values()), (sum(got.values()), sum(want.values()))
    missing, extra = want - got, got - want
    assert not missing and not extra, (list(missing)[:3], list(extra)[:3])
