"""Panels that the queries read, made from the star tables by Spark and, for the oracles, by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.labels import crash_label, forward_maxdd
from tidemark.sources.staging import stage

ENT, T = ["ent"], "t"


def _mean(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))


def price_panel(spark: SparkSession, d: str) -> DataFrame:
    """(ent, t, px, qty, disc, tax, n) per return flag and ship date."""
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("int")).cast("double") / F.count(F.lit(1))
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("ent"), F.to_date("l_shipdate").alias("t")).agg(
        _mean("l_extendedprice").alias("px"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"),
        hundredths("l_discount").alias("disc"), hundredths("l_tax").alias("tax"), F.count(F.lit(1)).alias("n"),
    )


PX = """px AS (SELECT l_returnflag AS ent, CAST(l_shipdate AS DATE) AS t, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / count(*) AS px,
  sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS qty, sum(round(l_discount * 100)::INT)::DOUBLE / count(*) AS disc,
  sum(round(l_tax * 100)::INT)::DOUBLE / count(*) AS tax, count(*) AS n FROM lineitem GROUP BY ALL)"""


def raw_panel(spark: SparkSession, d: str) -> DataFrame:
    """Indicator columns under their usual names, from the price panel. Written once: features read it several times, and each would aggregate the line items again."""
    return stage(price_panel(spark, d).select("ent", "t", *[F.expr(f"CAST({e} AS double)").alias(c) for c, e in RAW_COLUMNS.items()]), "raw")


RAW_COLUMNS = {
    "sp500_close": "px", "vix_close": "qty", "vxv_close": "qty + n", "yield_10y_3m": "disc", "yield_10y_2y": "tax", "yield_10y": "disc + tax", "hy_spread": "tax",
    "nfci": "disc - tax", "unemployment_rate": "n", "cpi": "px / 1000", "m2_money_supply": "px + qty", "initial_claims": "qty * n", "oil_wti": "px - qty",
    "dollar_twi": "px / qty", "baa_10y_spread": "disc * tax",
}
RAW = PX + ", raw AS (SELECT ent, t, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in RAW_COLUMNS.items()) + " FROM px)"


def macro_panel(spark: SparkSession, d: str) -> DataFrame:
    """(ent, t, v) per order priority and date."""
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("ent"), F.to_date("o_orderdate").alias("t")).agg(_mean("o_totalprice").alias("v"))


MACRO = "macro AS (SELECT o_orderpriority AS ent, CAST(o_orderdate AS DATE) AS t, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(*) AS v FROM orders GROUP BY ALL)"


def holes_panel(spark: SparkSession, d: str) -> DataFrame:
    """The price panel with values missing by a rule, for cleaning jobs."""
    hole = lambda c, m, r: F.when(F.pmod(F.unix_date("t"), F.lit(m)) != r, F.col(c))
    return price_panel(spark, d).select("ent", "t", hole("px", 7, 3).alias("px"), hole("qty", 11, 5).alias("qty"), hole("disc", 5, 1).alias("disc"), F.col("tax"))


HOLES = PX + """, holes AS (SELECT ent, t, CASE WHEN (t - DATE '1970-01-01') % 7 <> 3 THEN px END AS px,
  CASE WHEN (t - DATE '1970-01-01') % 11 <> 5 THEN qty END AS qty, CASE WHEN (t - DATE '1970-01-01') % 5 <> 1 THEN disc END AS disc, tax FROM px)"""


def vintages(spark: SparkSession, d: str) -> DataFrame:
    """(series, obs_date, release_date, value) with several releases of a date; every 13th value missing."""
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("obs_date"), F.expr("date_add(to_date(o_orderdate), int(o_orderkey % 40))").alias("release_date"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("value"),
    )


VINTAGES = """vint AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS obs_date, CAST(o_orderdate AS DATE) + (o_orderkey % 40)::INT AS release_date,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS value FROM orders)"""

#: Label of the scored panel: drawdown in percent, horizon in rows; p from which a row fires.
X, H, FIRE = 75.0, 21, 0.62


def scored_panel(spark: SparkSession, d: str) -> DataFrame:
    """Price panel with p in [0, 1], y (drawdown of X % within H rows), and features of the gate."""
    df = forward_maxdd(price_panel(spark, d), "px", H, ENT, T, "dd").withColumn("p", F.col("disc") / 10)
    return df.withColumn("y", crash_label("dd", X)).withColumn("tag", F.when(F.col("tax") >= 4, "rate_led").otherwise("credit_led"))


POS = "pos AS (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY t) AS pos FROM px)"


def forward_sql(h: int, name: str = "fw") -> str:
    return f"""{name} AS (SELECT ent, t, CASE WHEN count(*) = {h + 1} THEN max(1 - p / mx) * 100 END AS dd FROM (
  SELECT a.ent, a.t, b.px AS p, max(b.px) OVER (PARTITION BY a.ent, a.pos ORDER BY b.pos) AS mx
  FROM pos a JOIN pos b ON a.ent = b.ent AND b.pos BETWEEN a.pos AND a.pos + {h}) GROUP BY ent, t)"""


SCORED = PX + ", " + POS + ", " + forward_sql(H) + f""", scored AS (SELECT pos.*, dd, disc / 10 AS p, CASE WHEN dd IS NOT NULL THEN (dd >= {X})::INT::DOUBLE END AS y,
  CASE WHEN tax >= 4 THEN 'rate_led' ELSE 'credit_led' END AS tag FROM pos JOIN fw USING (ent, t))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the oracles' are."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def rounded_sql(ctes: str, body: str, columns: list[str], doubles: list[str], digits: int = 6) -> str:
    return f"WITH {ctes}, _out AS ({body}) SELECT " + ", ".join(f"round({c}::DOUBLE, {digits}) AS {c}" if c in doubles else c for c in columns) + " FROM _out"
