"""Readers, upserts and writers of indicator tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOOKKEEPING = ("id", "created_at", "updated_at")


def load_indicators(spark: SparkSession, path: str, fmt: str = "parquet", t: str = "date", **options: str) -> DataFrame:
    """Whole table with dates parsed and bookkeeping columns dropped; windows state their own order later."""
    df = spark.read.format(fmt).options(**options).load(path).drop(*BOOKKEEPING)
    return df.withColumn(t, F.to_date(t))


def indicators_between(df: DataFrame, start, end, t: str = "date") -> DataFrame:
    """Rows of [start, end], either side open if None, in order."""
    out = df if start is None else df.filter(F.col(t) >= F.lit(start).cast("date"))
    out = out if end is None else out.filter(F.col(t) <= F.lit(end).cast("date"))
    return out.orderBy(t)


def upsert_rows(target: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Target with the rows of `updates` put in: given columns win, even when null; others are kept.

    A key that stands twice in `updates` is an error of the caller; see `stream_upsert`.
    """
    new = [c for c in updates.columns if c not in key]
    columns = target.columns + [c for c in new if c not in target.columns]
    up = updates.withColumn("_new", F.lit(True)).select(*key, "_new", *[F.col(c).alias(f"_u_{c}") for c in new])
    both = target.join(up, list(key), "full_outer")
    value = lambda c: F.col(c) if c in key else F.col(c) if c not in new else (
        F.when(F.col("_new"), F.col(f"_u_{c}")).otherwise(F.col(c)) if c in target.columns else F.col(f"_u_{c}"))
    return both.select(*[value(c).alias(c) for c in columns])


def evolve_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing columns as null doubles."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def copy_and_reconcile(tables: dict[str, DataFrame], dst: str) -> DataFrame:
    """Write every table below `dst` with new ids; (table, n_source, n_copied, match)."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.drop("id").withColumn("id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{dst}/{name}")
        copied = spark.read.parquet(f"{dst}/{name}")
        one = lambda d, c: d.agg(F.count(F.lit(1)).alias(c)).withColumn("table", F.lit(name))
        counts.append(one(df, "n_source").join(one(copied, "n_copied"), "table"))
    return reduce(DataFrame.unionByName, counts).withColumn("match", F.col("n_source") == F.col("n_copied"))


def pick_source(df: DataFrame, source: str, priority: Sequence[str], ent: Sequence[str]) -> DataFrame:
    """Per entity the rows of its first source in `priority` that has any; whole sources, not row by row."""
    rank = reduce(lambda c, x: c.when(F.col(source) == x[1], x[0]), enumerate(priority), F)
    ranked = df.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    best = ranked.groupBy(*ent).agg(F.min("_rank").alias("_best"))
    return ranked.join(best, list(ent)).filter("_rank = _best").drop("_rank", "_best")


def parse_daily_json(df: DataFrame, json: str, field: str, ent: Sequence[str], start=None, end=None) -> DataFrame:
    """Nested JSON {date: {field: number}} to rows (ent, date, close)."""
    entries = F.explode(F.from_json(json, "map<string, map<string, string>>"))
    rows = df.select(*ent, entries.alias("_d", "_v")).select(
        *ent, F.expr("try_to_date(_d)").alias("date"), F.expr(f"try_cast(element_at(_v, '{field}') AS double)").alias("close")
    ).filter("date IS NOT NULL AND close IS NOT NULL")
    rows = rows if start is None else rows.filter(F.col("date") >= F.lit(start).cast("date"))
    return rows if end is None else rows.filter(F.col("date") <= F.lit(end).cast("date"))


def normalise_sheet(df: DataFrame, start=None, end=None) -> DataFrame:
    """(date, value) from a sheet whose columns are found by name; rows that don't parse are dropped."""
    bare = {c: c.strip().lower() for c in df.columns}
    date = next(c for c, b in bare.items() if "date" in b or "month" in b)
    value = next(c for c, b in bare.items() if "debit" in b or "margin" in b)
    rows = df.select(F.to_date(F.try_to_timestamp(F.col(f"`{date}`").cast("string"))).alias("date"), F.expr(f"try_cast(replace(`{value}`, ',', '') AS double)").alias("value"))
    rows = rows.dropna()
    rows = rows if start is None else rows.filter(F.col("date") >= F.lit(start).cast("date"))
    return rows if end is None else rows.filter(F.col("date") <= F.lit(end).cast("date"))


def put_call_ratio(chain: DataFrame, put: Column, call: Column, volume: str, by: Sequence[str]) -> DataFrame:
    """Put volume over call volume; kept where calls traded and the ratio is in [0.1, 10]."""
    total = lambda side: F.sum(F.when(side, F.coalesce(F.col(volume), F.lit(0))).otherwise(0))
    sums = chain.groupBy(*by).agg(total(put).alias("puts"), total(call).alias("calls"))
    return sums.filter("calls > 0").withColumn("ratio", F.try_divide(F.col("puts"), F.col("calls"))).filter("ratio BETWEEN 0.1 AND 10")


def resample_daily_ffill(df: DataFrame, ent: Sequence[str], ts: str, value: str) -> DataFrame:
    """(ent, d, value, filled): daily means, days without rows carry the last one forward."""
    daily = df.groupBy(*ent, F.to_date(ts).alias("d")).agg(F.avg(value).alias("v"))
    days = daily.groupBy(*ent).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).select(*ent, F.explode(F.sequence("lo", "hi")).alias("d"))
    w = Window.partitionBy(*ent).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(daily, [*ent, "d"], "left").select(*ent, "d", F.last("v", True).over(w).alias("value"), F.col("v").isNull().alias("filled"))


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, as reports are written."""
    kinds = dict(df.dtypes)
    clean = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c)
    return df.select(*[clean(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Replace `path` by the table, without values that JSON can't hold."""
    finite(df).write.mode("overwrite").format(fmt).save(path)
