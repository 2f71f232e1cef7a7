"""Rows of two engines, made comparable."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if (path := Path(sf_dir, f"{t}.parquet")).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows_of(names, found.fetchall())
