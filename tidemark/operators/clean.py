"""Missing values, ranges, quality scores and the screen for fabricated columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Ent, from_here, order, pct_change, so_far

Ranges = dict[str, tuple[float | None, float | None]]


def missing_stats(df: DataFrame, columns: Sequence[str], limit_pct: float = 5.0) -> DataFrame:
    """Per column: n_missing, pct, critical (over the limit); and the totals of the whole table in each row."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0))
    long = one.select("_n", total.alias("total_missing"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("x"))
    pct = F.try_divide(F.col("x.n_missing") * 100.0, F.col("_n"))
    return long.select("x.column", "x.n_missing", pct.alias("pct"), (pct > limit_pct).alias("critical"), "total_missing",
                       F.try_divide(F.col("total_missing") * 100.0, F.col("_n") * len(columns)).alias("overall_pct"))


def range_violations(df: DataFrame, ranges: Ranges) -> DataFrame:
    """Per configured bound with violations: column, bound, limit, n. Nulls and NaN never violate."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    bounds = [(c, b, x) for c, lo_hi in ranges.items() if c in df.columns for b, x in zip(("min", "max"), lo_hi) if x is not None]
    broken = lambda c, b, x: ok(c) & (F.col(c) < x if b == "min" else F.col(c) > x)
    one = df.agg(*[F.count_if(broken(*x)).alias(f"_{i}") for i, x in enumerate(bounds)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(b).alias("bound"), F.lit(float(x)).alias("limit"), F.col(f"_{i}").alias("n")) for i, (c, b, x) in enumerate(bounds)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter("n > 0")


def fill_missing(df: DataFrame, ffill: Sequence[str], interpolate: Sequence[str], ent: Ent, t: str) -> DataFrame:
    """Forward fill; linear interpolation by row position (trailing nulls take the last value); then fill all backwards."""
    cur = df.withColumn("_pos", F.row_number().over(order(ent, t)))
    for c in ffill:
        cur = cur.withColumn(c, F.last(c, True).over(so_far(ent, t)))
    for c in interpolate:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).cast("double").alias("v")))
        cur = cur.withColumns({"_a": F.last(point, True).over(so_far(ent, t)), "_b": F.last(point, True).over(from_here(ent, t))})
        line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_pos") - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
        cur = cur.withColumn(c, F.coalesce(F.col(c).cast("double"), F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNotNull(), line))).drop("_a", "_b")
    for c in [*ffill, *interpolate]:
        cur = cur.withColumn(c, F.last(c, True).over(from_here(ent, t)))
    return cur.drop("_pos")


def quality_score(df: DataFrame, columns: Sequence[str], ranges: Ranges) -> DataFrame:
    """0.6 max(0, 1 - missing % / 100) + 0.4 max(0, 1 - violated bounds / cells)."""
    miss = missing_stats(df, columns).agg(F.first("overall_pct").alias("_pct"))
    cells = df.agg((F.count(F.lit(1)) * len(columns)).alias("_cells"))
    bad = range_violations(df, ranges).agg(F.count(F.lit(1)).alias("_bad"))
    one = miss.crossJoin(cells).crossJoin(bad)  # three one-row frames
    part = lambda x: F.greatest(F.lit(0.0), 1 - x)
    return one.select((0.6 * part(F.coalesce("_pct", F.lit(0.0)) / 100) + 0.4 * part(F.coalesce(F.try_divide(F.col("_bad"), F.col("_cells")), F.lit(0.0)))).alias("score"))


def validate_frame(df: DataFrame, columns: Sequence[str], ranges: Ranges, t: str) -> DataFrame:
    """One row: shape, dates, missing share, violated bounds and score."""
    shape = df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(columns)).alias("n_columns"), F.min(t).alias("first_date"), F.max(t).alias("last_date"))
    miss = missing_stats(df, columns).agg(F.first("total_missing").alias("total_missing"), F.first("overall_pct").alias("overall_pct"))
    bad = range_violations(df, ranges).agg(F.count(F.lit(1)).alias("n_violations"))
    return shape.crossJoin(miss).crossJoin(bad).crossJoin(quality_score(df, columns, ranges))  # one-row frames


def legacy_clean(df: DataFrame, columns: Sequence[str], price: str, ent: Ent, t: str) -> DataFrame:
    """Fill forward then backward (price only forward); what is left becomes the entity's mean."""
    cur = df
    for c in columns:
        ahead = F.last(c, True).over(so_far(ent, t))
        cur = cur.withColumn(f"_f_{c}", ahead)
    for c in columns:
        back = F.last(f"_f_{c}", True).over(from_here(ent, t))
        cur = cur.withColumn(c, F.col(f"_f_{c}") if c == price else F.coalesce(F.col(f"_f_{c}"), back))
    means = {c: F.coalesce(F.col(c), F.avg(c).over(Window.partitionBy(*ent))) for c in columns}
    return cur.withColumns(means).drop(*[f"_f_{c}" for c in columns])


def proxy_columns(df: DataFrame, spread: str, vix: str, ent: Ent, t: str, clip: bool = True) -> DataFrame:
    """margin_debt and put_call_ratio where there is no better source."""
    raw = 0.5 * pct_change(vix, 1, ent, t)
    move = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), raw)) if clip else raw  # these skip nulls
    return df.withColumns({"margin_debt": F.try_divide(F.lit(100.0), F.col(spread) + 1), "put_call_ratio": F.when(raw.isNotNull(), 1 + move)})


def _long(df: DataFrame, columns: Sequence[str], ent: Ent, t: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*ent, F.col(t).alias("_t"), F.explode(cells).alias("x")).select(*ent, "_t", "x.*").filter("value IS NOT NULL")


def _runs(df: DataFrame, columns: Sequence[str], ent: Ent, t: str) -> DataFrame:
    """The long table with `_prev`, the value before, and `_run`, the length of the run of one value up to the row."""
    w = Window.partitionBy(*ent, "column").orderBy("_t")
    long = _long(df, columns, ent, t).withColumns({"_prev": F.lag("value").over(w), "_pos": F.row_number().over(w)})
    start = F.when(F.col("_prev").isNull() | (F.col("value") != F.col("_prev")), F.col("_pos"))
    return long.withColumn("_run", F.col("_pos") - F.last(start, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def longest_constant_run(df: DataFrame, columns: Sequence[str], ent: Ent, t: str) -> DataFrame:
    """Per (entity, column): the longest run of one value among those that aren't null."""
    return _runs(df, columns, ent, t).groupBy(*ent, "column").agg(F.max("_run").cast("long").alias("longest_run"))


@dataclass(frozen=True)
class Thresholds:
    """Limits of the screen. quarantine: columns known to be fabricated."""

    min_obs: int = 252
    max_run_share: float = 0.10
    min_rel_std: float = 1e-6
    min_autocorr: float = 0.30
    noise_rel_std: float = 0.05
    quarantine: tuple[str, ...] = ()


def screen_columns(df: DataFrame, columns: Sequence[str], ent: Ent, t: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """Per (entity, column): statistics, verdict (`ok` or the first failed check) and reason, failed columns first."""
    by = [*ent, "column"]
    stats = _runs(df, columns, ent, t).groupBy(*by).agg(
        F.count("value").alias("n_obs"), F.min("_t").alias("first_valid"), F.max("_t").alias("last_valid"), F.corr("value", "_prev").alias("autocorr"),
        F.try_divide(F.stddev_samp("value"), F.avg(F.abs("value"))).alias("rel_std"), F.max("_run").cast("long").alias("longest_run"),
    )
    noise = (F.col("autocorr") < limits.min_autocorr) & (F.col("rel_std") > 0) & (F.col("rel_std") < limits.noise_rel_std)
    checks = [
        ("quarantined", F.col("column").isin(*limits.quarantine) if limits.quarantine else F.lit(False)), ("too_short", F.col("n_obs") < limits.min_obs),
        ("constant_fill", F.col("longest_run") > limits.max_run_share * F.col("n_obs")), ("no_variation", F.coalesce(F.col("rel_std"), F.lit(0.0)) < limits.min_rel_std),
        ("implausible_noise", noise),
    ]
    verdict = reduce(lambda c, x: c.when(x[1], x[0]), checks, F).otherwise("ok")
    out = stats.withColumn("verdict", verdict)
    reason = F.when(F.col("verdict") != "ok", F.format_string("%s: n=%d run=%d", "verdict", "n_obs", "longest_run"))
    return out.withColumn("reason", reason).orderBy((F.col("verdict") == "ok").cast("int"), F.desc("n_obs"), *by)


def rejected_columns(verdicts: DataFrame) -> dict[str, str]:
    """Column to reason; the table has one row per column and entity, which bounds it."""
    return {r["column"]: r["reason"] for r in verdicts.filter("verdict <> 'ok'").select("column", "reason").collect()}


def apply_screen(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`df` without the columns that fail anywhere."""
    return df.drop(*rejected_columns(verdicts))


def resolve_price(df: DataFrame, candidates: Sequence[str], ent: Ent, t: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """Per entity the candidate that passes the screen with most values, ties by preference: (ent, column, n_obs)."""
    passed = screen_columns(df, [c for c in candidates if c in df.columns], ent, t, limits).filter("verdict = 'ok'")
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("column"))
    w = Window.partitionBy(*ent).orderBy(F.desc("n_obs"), rank)
    return passed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*ent, "column", "n_obs")
