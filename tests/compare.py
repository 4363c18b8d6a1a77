"""Runs a query and its SQL over the same tables and compares their rows."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(x):
    return str(x) if isinstance(x, datetime.datetime | bytearray | float) else x


def compare(df, sql, sf_dir):
    want = views(sf_dir).sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    expected = sorted((tuple(plain(x) for x in r) for r in want.select(*(f'"{c}"' for c in names)).fetchall()), key=key)
    assert len(got) == len(expected)
    assert got == expected
