"""Exact quantiles of columns of any length."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import stage

#: Values that one task may gather; more are ranked in ranges.
VALUES_IN_TASK = 1_000_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """For each column its quantiles at `shares`, linear between neighbours; nulls don't count, None without a value.

    Up to VALUES_IN_TASK values in all, one aggregate gathers them. Beyond that, counts of
    distinct values are sorted in ranges, the ranges' totals give each range its first rank,
    and only the values at the wanted ranks leave Spark. Both ways give the same numbers.
    """
    names = {f"c{i}": c for i, c in enumerate(columns)}
    cells = df.select(*[F.col(c).cast("double").alias(n) for n, c in names.items()])
    sizes = cells.agg(*[F.count(n).alias(n) for n in names]).first().asDict() if names else {}
    if sum(sizes.values()) <= VALUES_IN_TASK:
        found = cells.agg(*[F.percentile(n, F.array(*[F.lit(float(s)) for s in shares])).alias(n) for n in names]).first() if names else {}
        return {c: found[n] for n, c in names.items()}
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*").filter("v IS NOT NULL")
    parts = stage(long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("c", "v").withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy("c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range and column
    start = parts.groupBy("c", "_part").agg(F.sum("n").alias("_s")).select("c", "_part", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("c", "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.withColumn("_upto", F.sum("n").over(inside)).join(F.broadcast(start), ["c", "_part"]).withColumn("_upto", F.col("_upto") + F.col("_start"))
    at = {n: [s * (sizes[n] - 1) for s in shares] for n in names if sizes[n]}
    wanted = sorted({(n, k) for n, ps in at.items() for p in ps for k in (math.floor(p), math.ceil(p))})
    ranks = F.broadcast(df.sparkSession.createDataFrame(wanted, "c string, k long"))  # columns x shares x 2
    here = (F.col("k") < F.col("_upto")) & (F.col("k") >= F.col("_upto") - F.col("n"))
    value = {(r["c"], r["k"]): r["v"] for r in ranked.join(ranks, "c").filter(here).select("c", "k", "v").collect()}
    between = lambda n, p: value[n, math.floor(p)] * (math.ceil(p) - p) + value[n, math.ceil(p)] * (p - math.floor(p)) if p % 1 else value[n, int(p)]
    return {c: [between(n, p) for p in at[n]] if n in at else None for n, c in names.items()}


def _ranked(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values `_v` of each group with `_n` rows, `_upto` rows of the group at or below, and the group's `_total`.

    Counts of distinct (group, value) are sorted in ranges; the ranges' totals give a group's first rank in each.
    """
    parts = stage(cells.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "grouped")
    sums = parts.groupBy("_part", *by).agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(*by)  # a row per range in which the group has values
    start = sums.select(
        F.col("_part").alias("_in_part"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.sum("_s").over(group).alias("_total"),
        F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    same = F.col("_part") == F.col("_in_part")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_part", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_upto", F.sum("_n").over(inside)).join(start, same).withColumn("_upto", F.col("_upto") + F.col("_start"))


def _at(rank: Column) -> Column:
    """Aggregate: the value at a rank (from 0) of the group."""
    return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")), F.col("_v")))


def grouped_medians(df: DataFrame, by: Sequence[str], value: Column, out: str) -> DataFrame:
    """(by, out, n): each group's exact median and number of values; a group with any number of values is many tasks."""
    ranked = _ranked(df.select(*by, value.cast("double").alias("_v")).filter("_v IS NOT NULL"), by)
    low, high = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    return ranked.groupBy(*by).agg(((_at(low) + _at(high)) / 2).alias(out), F.max("_total").alias("n"))


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: Column, shares: Sequence[float], out: str = "q") -> DataFrame:
    """(by, out): each group's exact quantiles at `shares`, linear between neighbours, as an array; nulls don't count.

    Groups of at most VALUES_IN_TASK values are gathered in one aggregate; where one has more, all
    are ranked in ranges. Both ways give the same numbers.
    """
    cells = df.select(*by, value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    if (cells.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= VALUES_IN_TASK:
        return cells.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares])).alias(out))
    ranked, found = _ranked(cells, by), []
    for s in shares:
        at = (F.col("_total") - 1) * float(s)
        low, high = F.floor(at), F.ceil(at)
        over = F.max(at - low)
        found.append(F.when(over > 0, _at(low) * (1 - over) + _at(high) * over).otherwise(_at(low)))
    return ranked.groupBy(*by).agg(F.array(*found).alias(out))
