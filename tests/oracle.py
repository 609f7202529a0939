"""Comparison of a query's rows with its SQL in DuckDB, as the driver does it."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def key(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.5f}".replace("-0.00000", "0.00000")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(key(r[i]) for i in order) for r in rows)


def duck(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    return columns, out.fetchall()


def compare(df, sf, sql):
    columns, rows = duck(sf, sql)
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    mine, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, rows)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(mine)
