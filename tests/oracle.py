"""Compare a query's rows with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, sql: str, con) -> None:
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [list(rel.columns).index(c) for c in names]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
