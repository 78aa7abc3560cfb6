"""Comparison of a Spark result with the SQL oracle."""

import glob
import os

import duckdb


def _cell(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return repr(x + 0.0)
    return str(x)


def compare(df, sql: str, folder: str) -> int:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql).to_arrow_table()
    got = df.toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    a = sorted((tuple(_cell(x) for x in r) for r in zip(*(got.column(c).to_pylist() for c in names))), key=str)
    b = sorted((tuple(_cell(x) for x in r) for r in zip(*(want.column(c).to_pylist() for c in names))), key=str)
    assert a == b, ([x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    return len(a)
