"""Compares a DataFrame with the rows of a DuckDB query, as sorted, rounded values."""

import glob
import os

import duckdb


def database(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 5) + 0.0)
    return str(v)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
