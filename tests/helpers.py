"""Panels by hand and the comparison with DuckDB."""

import datetime as dt
import math
import os

import duckdb

DAY0 = dt.date(2000, 1, 3)


def panel(spark, prices, ent="a"):
    rows = [(ent, DAY0 + dt.timedelta(days=i), None if p is None else float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "ent string, t date, px double")


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*(order or ("t",))).collect()]


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, dt.datetime) and v.time() == dt.time(0):
        return v.date()
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(records, columns):
    return sorted((tuple(normal(r[c]) for c in columns) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return [dict(zip(names, r)) for r in out.fetchall()], names
