"""Compare a query with its SQL on the same tables."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def both(spark, con, query, sql, folder):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    result = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == names
    return got, sorted(repr(tuple(r[at[n]] for n in names)) for r in result.fetchall())
