"""Compares a query's rows with its oracle SQL run by DuckDB over the same tables."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection(sf_dir=SF):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return db


def rows_of(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


def assert_matches(df, sql, sf_dir=SF):
    want, got = connection(sf_dir).sql(sql).df(), df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
