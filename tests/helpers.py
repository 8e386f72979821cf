"""Rows of a query against its SQL, as the driver compares them."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


def oracle_rows(sql, sf=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows_of(names, found.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])
