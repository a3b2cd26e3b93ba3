"""Rows of a query against rows of its SQL, without regard to order."""

import datetime
import decimal
import json

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (float, decimal.Decimal)):
        return None if x != x else round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)[:19]
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(json.dumps([plain(r[i]) for i in order], default=str) for r in data)


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())
