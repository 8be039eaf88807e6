"""Spark's result against DuckDB's on the same tables."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    for t in os.listdir(folder):
        c.execute(f"create view {t.split('.')[0]} as select * from '{folder}/{t}'")
    return c


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql, c):
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    result = c.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(result.fetchall(), columns)
