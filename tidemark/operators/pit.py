"""Point-in-time alignment: what was known on each day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import grouped_medians
from tidemark.functions.windows import so_far

#: First date from which vintages were archived as they came; earlier release dates are back-filled.
ARCHIVE_START = "1997-02-04"


def first_release(vintages: DataFrame) -> DataFrame:
    """Per (series, obs_date) the first release date and the first value that isn't null.

    The value may come from a later release than the kept date; dates without any value go.
    """
    has = F.when(F.col("value").isNotNull(), F.struct("release_date", "value"))
    return vintages.groupBy("series", "obs_date").agg(F.min("release_date").alias("release_date"), F.min(has)["value"].alias("value")).filter("value IS NOT NULL")


def release_lag(first: DataFrame, fallback: float, start: str = ARCHIVE_START) -> DataFrame:
    """Per series the median lag in days of genuine releases (after `start`), else `fallback`."""
    genuine = F.col("release_date") > F.lit(start).cast("date")
    return first.groupBy("series").agg(F.coalesce(F.median(F.when(genuine, F.datediff("release_date", "obs_date"))), F.lit(float(fallback))).alias("lag_days"))


def known_on(first: DataFrame, lags: DataFrame, start: str = ARCHIVE_START) -> DataFrame:
    """Add known_on: the release date if genuine, else the observation date plus the lag (whole days, floored)."""
    genuine = F.col("release_date") > F.lit(start).cast("date")
    return first.join(lags, "series").withColumn("known_on", F.when(genuine, F.col("release_date")).otherwise(F.expr("date_add(obs_date, int(floor(lag_days)))")))


def collapse_same_day(known: DataFrame) -> DataFrame:
    """One value per (series, known_on): that of the latest observation with a value."""
    return known.filter("value IS NOT NULL").groupBy("series", "known_on").agg(F.max_by("value", "obs_date").alias("value"), F.max("obs_date").alias("obs_date"))


def extend_pre_vintage(known: DataFrame, plain: DataFrame, lags: DataFrame, fallback: float) -> DataFrame:
    """`known` with rows of the latest vintage, shifted by the lag, that fall before the first known date.

    A series without vintages is all of its shifted rows.
    """
    first = known.groupBy("series").agg(F.min("known_on").alias("_first"))
    shifted = plain.join(lags, "series", "left").withColumn("known_on", F.expr(f"date_add(obs_date, int(floor(coalesce(lag_days, {float(fallback)}))))"))
    early = shifted.join(first, "series", "left").filter("_first IS NULL OR known_on < _first")
    return collapse_same_day(known.select("series", "known_on", "obs_date", "value").unionByName(early.select("series", "known_on", "obs_date", "value")))


def splice_series(primary: DataFrame, historical: DataFrame, min_overlap: int = 20) -> DataFrame:
    """Primary (series, t, value), extended backwards by historical times the median ratio of common days."""
    both = primary.join(historical.select("series", "t", F.col("value").alias("_h")), ["series", "t"])
    ratio = grouped_medians(both, ["series"], F.try_divide(F.col("value"), F.col("_h")), "_ratio").filter(F.col("n") >= min_overlap).drop("n")
    start = primary.groupBy("series").agg(F.min("t").alias("_start"))
    older = historical.join(start, "series").filter("t < _start").join(ratio, "series", "left")
    return primary.select("series", "t", "value").unionByName(older.select("series", "t", (F.col("value") * F.coalesce("_ratio", F.lit(1.0))).alias("value")))


def build_calendar(existing: DataFrame, price: DataFrame, t: str = "t") -> DataFrame:
    return existing.select(t).union(price.select(t)).distinct()


def shift_publication(df: DataFrame, catalogue: DataFrame, t: str = "t") -> DataFrame:
    """Dates of series with rule `lag` moved by their lag days. catalogue: (series, rule, lag_days), one row per series."""
    out = df.join(F.broadcast(catalogue), "series", "left")  # a catalogue of series is written by hand
    return out.withColumn(t, F.when(F.col("rule") == "lag", F.expr(f"date_add({t}, lag_days)")).otherwise(F.col(t))).drop("rule", "lag_days")


def asof_align(values: DataFrame, calendar: DataFrame, max_staleness: int | Column, ent: Sequence[str], t: str = "t", value: str = "value") -> DataFrame:
    """Each calendar row gets the latest value on or before its day, null when older than `max_staleness` days.

    Values and calendar rows are united and sorted once per entity; the last value so far is
    the answer. No pair of a value and a day is made.
    """
    stamp = F.struct(F.col(value).alias("v"), F.col(t).alias("s"))
    left = values.select(*ent, t, F.when(F.col(value).isNotNull(), stamp).alias("_v"), F.lit(0).alias("_cal"))
    right = calendar.select(*ent, t, F.lit(None).cast(left.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_cal"))
    w = Window.partitionBy(*ent).orderBy(t, "_cal").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("_last", F.last("_v", True).over(w)).filter("_cal = 1")
    age = F.datediff(F.col(t), F.col("_last.s"))
    limit = F.lit(max_staleness) if isinstance(max_staleness, int) else max_staleness
    return seen.select(*ent, t, F.when(age <= limit, F.col("_last.v")).alias(value), age.alias("age_days"))


def assemble_wide(aligned: DataFrame, series: Sequence[str], ent: Sequence[str], t: str = "t") -> DataFrame:
    """One column per listed series."""
    return aligned.groupBy(*ent, t).pivot("series", list(series)).agg(F.first("value"))


def merge_sources_left(frame: DataFrame, *sources: DataFrame, t: str = "t") -> DataFrame:
    """Columns of the sources put beside `frame`, matched on plain dates; frame's rows decide."""
    out = frame.withColumn(t, F.to_date(t))
    for source in sources:
        out = out.join(source.withColumn(t, F.to_date(t)).dropDuplicates([t]), t, "left")
    return out


def coverage_report(df: DataFrame, columns: Sequence[str], t: str = "t") -> DataFrame:
    """Per column: n values, first and last date."""
    long = df.select(F.col(t).alias("_t"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    seen = F.when(F.col("x.v").isNotNull(), F.col("_t"))
    return long.groupBy(F.col("x.column").alias("column")).agg(F.count("x.v").alias("n"), F.min(seen).alias("first_date"), F.max(seen).alias("last_date"))


def coverage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    joined = before.select("column", F.col("n").alias("n_before")).join(after.select("column", F.col("n").alias("n_after")), "column", "full_outer").fillna(0, ["n_before", "n_after"])
    return joined.withColumn("gained", F.col("n_after") - F.col("n_before"))


def carry_forward(c: str, ent: Sequence[str], t: str) -> Column:
    return F.last(c, True).over(so_far(ent, t))
