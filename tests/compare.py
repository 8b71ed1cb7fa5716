"""Compares a plan with SQL on the same tables, without regard to order."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


def assert_same(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    mine, theirs = df.collect(), other.fetchall()
    assert len(mine) == len(theirs)
    kind = {k: i for k, i in zip(df.columns, [f.dataType.typeName() for f in df.schema], strict=True)}
    if any(k in ("double", "float") for k in kind.values()):  # whole numbers on one side may be doubles on the other
        mine, theirs = ([[float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r] for r in x] for x in (mine, theirs))
    assert rows(df.columns, mine) == rows(other.columns, theirs)
