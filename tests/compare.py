"""Rows of a query and of its SQL, in a form that compares."""

import glob
import math
import os


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def duck_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = con.sql(sql)
    columns = sorted(got.columns)
    return columns, sorted(repr(tuple(plain(r[got.columns.index(c)]) for c in columns)) for r in got.fetchall())
