"""Alarms and the queries that serve predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Ent, last_rows, order

# Rows back, change a day from which it is an alarm, severity; and levels of risk.
ML_ALARM = ((1, 0.10, "high"), (5, 0.05, "medium"), (20, 0.02, "low"))
STAT_ALARM = ((1, 0.08, "high"), (5, 0.04, "medium"), (20, 0.015, "low"))
RISK = ((0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MODERATE"), (0.2, "LOW"))


def roc_alarm(df: DataFrame, p: str, ent: Ent, t: str, thresholds=ML_ALARM, out: str = "alarm") -> DataFrame:
    """Severity of the first change a day above its threshold, over 1, 5 and 20 rows; `none` with under two earlier rows."""
    w = order(ent, t)
    change = lambda k: F.when(F.lag(p, k).over(w) == 0, 0.0).otherwise((F.col(p) - F.lag(p, k).over(w)) / F.lag(p, k).over(w) / k)
    hit = reduce(lambda c, x: c.when(change(x[0]) > x[1], x[2]), thresholds, F.when(F.row_number().over(w) <= 2, "none"))
    return df.withColumn(out, hit.otherwise("none"))


def combined_alarm(df: DataFrame, a: str, b: str, out: str = "combined") -> DataFrame:
    n = (F.col(a) != "none").cast("int") + (F.col(b) != "none").cast("int")
    return df.withColumn(out, F.when(n == 2, "critical").when(n == 1, "warning").otherwise("none"))


def slope_alert(df: DataFrame, p: str, ent: Ent, t: str, window: int = 5) -> DataFrame:
    """Change a day over the last `window` points, its level (2 from 0.10, 1 from 0.05) and alert (level 2)."""
    w = last_rows(window, ent, t)
    days = F.datediff(F.last(t).over(w), F.first(t).over(w))
    cur = df.withColumn("slope", F.when(F.count(F.lit(1)).over(w) >= 2, F.try_divide(F.last(p).over(w) - F.first(p).over(w), F.nullif(days, F.lit(0)))))
    level = F.when(F.abs("slope") >= 0.10, 2).when(F.abs("slope") >= 0.05, 1).when(F.col("slope").isNotNull(), 0)
    return cur.withColumn("level", level).withColumn("alert", F.coalesce(F.col("level") >= 2, F.lit(False)))


def risk_level(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return reduce(lambda c, x: c.when(p >= x[0], x[1]), RISK, F.when(p.isNull(), None)).otherwise("MINIMAL")


def threshold_alert(df: DataFrame, p: str, threshold: float) -> DataFrame:
    return df.filter(F.col(p) >= threshold).withColumn("severity", F.lit("critical"))


def latest_prediction(df: DataFrame, t: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(t), F.desc(key)).limit(1)


def prediction_history(df: DataFrame, t: str, key: str, start=None, end=None, limit: int = 100) -> DataFrame:
    """Newest first, 1 to 1000 rows, with count, first and last date of what is returned."""
    rows = df if start is None else df.filter(F.col(t) >= F.lit(start))
    rows = rows if end is None else rows.filter(F.col(t) <= F.lit(end))
    page = rows.orderBy(F.desc(t), F.desc(key)).limit(min(max(limit, 1), 1000))
    whole = Window.partitionBy()
    return page.withColumns({"n": F.count(F.lit(1)).over(whole), "first_date": F.min(t).over(whole), "last_date": F.max(t).over(whole)})  # at most 1000 rows


def crash_history(crashes: DataFrame) -> DataFrame:
    return crashes.orderBy(F.desc("start_date"), F.desc("trough_date"))


def alert_log_tail(df: DataFrame, t: str, key: str, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc(t), F.desc(key)).limit(n)


def fire_breakdown(df: DataFrame, fires: Column, tag: str, reason: str, top: int = 10) -> DataFrame:
    """(kind, name, n): fires by tag, and the most frequent reasons of rows that don't fire."""
    tags = df.filter(fires).groupBy(F.col(tag).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("archetype"))
    whys = df.filter(~fires).groupBy(F.col(reason).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(top).withColumn("kind", F.lit("reason"))
    return tags.unionByName(whys).select("kind", "name", "n")


def days_to_bottom(df: DataFrame, made: str, bottom: str, recovery: str, key: str, n: int = 30) -> DataFrame:
    """Days from the prediction to its bottom and recovery, the last 30."""
    return df.orderBy(F.desc(made), F.desc(key)).limit(n).withColumns({"days_to_bottom": F.datediff(bottom, made), "days_to_recovery": F.datediff(recovery, made)})


def coverage_status(coverage: DataFrame, total: Column, n: str = "n") -> DataFrame:
    """pct of rows with a value: ok from 50, sparse above 0, else empty."""
    pct = F.try_divide(F.col(n) * 100.0, total)
    return coverage.withColumn("pct", pct).withColumn("status", F.when(pct >= 50, "ok").when(pct > 0, "sparse").otherwise("empty"))
