"""Compares a query with its SQL as the driver does: rows, names, types, values."""

import glob
import os

import duckdb

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names, kinds, rows = [d[0] for d in found.description], [str(d[1]) for d in found.description], found.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert {n: TYPES.get(k, k) for n, k in zip(names, kinds)} == dict(got.dtypes)
    order = sorted(names)
    said = lambda row: [repr(row[n]) for n in order]
    assert sorted(said(dict(zip(names, r))) for r in rows) == sorted(said(r.asDict()) for r in got.collect())
