"""Queries of sources and sinks, alignment and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, pit
from tidemark.plans.panels import ENT, HOLES, MACRO, PX, T, VINTAGES, holes_panel, macro_panel, price_panel, rounded, vintages
from tidemark.sources import tables
from tidemark.sources.staging import new_path

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("load_indicators", f"WITH {PX} SELECT ent, t AS date, px, qty FROM px")
def _(spark, d):
    path = new_path(spark, "indicators")
    price_panel(spark, d).select("ent", F.col("t").alias("date"), "px", "qty", F.lit(1).alias("id"), F.current_timestamp().alias("created_at")).write.parquet(path)
    return tables.load_indicators(spark, path)


@query("indicators_between", f"WITH {PX} SELECT ent, t, px FROM px WHERE t BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def _(spark, d):
    return tables.indicators_between(price_panel(spark, d).select("ent", "t", "px"), "1995-01-01", "1996-12-31", "t")



@query("upsert_rows", f"""WITH {PX}, u AS (SELECT ent, CASE WHEN month(t) = 1 THEN t + 40000 ELSE t END AS t, CASE WHEN day(t) <> 1 THEN px * 2 END AS px FROM px WHERE year(t) = 1996)
  SELECT coalesce(p.ent, u.ent) AS ent, coalesce(p.t, u.t) AS t, CASE WHEN u.ent IS NOT NULL THEN u.px ELSE p.px END AS px, p.qty FROM px p FULL JOIN u ON p.ent = u.ent AND p.t = u.t""")
def _(spark, d):
    panel = price_panel(spark, d).select("ent", "t", "px", "qty")
    day = F.when(F.month("t") == 1, F.date_add("t", 40000)).otherwise(F.col("t"))
    updates = panel.filter(F.year("t") == 1996).select("ent", day.alias("t"), F.when(F.dayofmonth("t") != 1, F.col("px") * 2).alias("px"))
    return tables.upsert_rows(panel, updates, ["ent", "t"])


@query("evolve_schema", f"WITH {PX} SELECT ent, t, px, NULL::DOUBLE AS vxo_close, NULL::DOUBLE AS kcfsi FROM px")
def _(spark, d):
    return tables.evolve_schema(price_panel(spark, d).select("ent", "t", "px"), ["px", "vxo_close", "kcfsi"])


@query("copy_and_reconcile", 'SELECT \'nation\' AS "table", count(*) AS n_source, count(*) AS n_copied, true AS match FROM nation UNION ALL SELECT \'orders\', count(*), count(*), true FROM orders')
def _(spark, d):
    return tables.copy_and_reconcile({t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "orders")}, new_path(spark, "copy"))


@query("pick_source", """WITH b AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 END AS r FROM events WHERE value > 40),
  m AS (SELECT user_id, min(r) AS best FROM b GROUP BY user_id) SELECT user_id, event_id, event_type, value FROM b JOIN m USING (user_id) WHERE r = best""")
def _(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").filter("value > 40")
    return tables.pick_source(ev, "event_type", ["purchase", "signup", "view"], ["user_id"]).select("user_id", "event_id", "event_type", "value")


@query("parse_daily_json", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS v FROM events GROUP BY ALL)
  SELECT user_id, date, v AS close FROM e WHERE date >= DATE '2024-01-10'""")
def _(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.to_date("ts").cast("string").alias("k")).agg(F.max("value").cast("string").alias("v"))
    entry = F.struct("k", F.create_map(F.lit("5. adjusted close"), F.col("v")).alias("m"))
    json = ev.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return tables.parse_daily_json(json, "json", "5. adjusted close", ["user_id"], start="2024-01-10")


@query("normalise_sheet", "SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM orders WHERE o_orderkey % 5 <> 0 AND CAST(o_orderdate AS DATE) >= DATE '1995-01-01'")
def _(spark, d):
    text = F.when(F.col("o_orderkey") % 5 != 0, F.format_number(F.col("o_totalprice"), 2)).otherwise("n/a")
    sheet = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias(" Year-Month Date "), text.alias(" Debit Balances "))
    return tables.normalise_sheet(sheet, start="1995-01-01")


@query("put_call_ratio", """WITH s AS (SELECT CAST(ts AS DATE) AS expiry, sum(CASE WHEN event_type = 'view' THEN (event_id % 50) ELSE 0 END)::BIGINT AS puts,
  sum(CASE WHEN event_type = 'click' THEN (event_id % 50) ELSE 0 END)::BIGINT AS calls FROM events GROUP BY 1) SELECT *, round(puts / calls, 6) AS ratio FROM s WHERE calls > 0 AND puts / calls BETWEEN 0.1 AND 10""")
def _(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("expiry"), "event_type", (F.col("event_id") % 50).alias("volume"))
    return rounded(tables.put_call_ratio(ev, F.col("event_type") == "view", F.col("event_type") == "click", "volume", ["expiry"]))


@query("resample_daily_ffill", """WITH a AS (SELECT user_id, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY ALL),
  s AS (SELECT user_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM a GROUP BY user_id)
  SELECT user_id, d, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS value, v IS NULL AS filled FROM s LEFT JOIN a USING (user_id, d)""")
def _(spark, d):
    return rounded(tables.resample_daily_ffill(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "ts", "value"))


@query("write_report", f"WITH {PX} SELECT ent, count(*) AS n, CASE WHEN ent <> 'A' THEN round(avg(px), 6) END AS mean_px FROM px GROUP BY ent")
def _(spark, d):
    path = new_path(spark, "report")
    report = price_panel(spark, d).groupBy("ent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("px"), 6).alias("m"))
    tables.write_report(report.select("ent", "n", F.when(F.col("ent") == "A", F.lit(float("nan"))).otherwise(F.col("m")).alias("mean_px")), path)
    return spark.read.schema("ent string, n long, mean_px double").json(path)


FIRST = VINTAGES + """, fr AS (SELECT series, obs_date, min(release_date) AS release_date, min(CASE WHEN value IS NOT NULL THEN {'d': release_date, 'v': value} END).v AS value
  FROM vint GROUP BY ALL HAVING count(value) > 0)"""
LAGS = FIRST + """, lag AS (SELECT series, coalesce(median(CASE WHEN release_date > DATE '1997-02-04' THEN release_date - obs_date END), 30)::DOUBLE AS lag_days FROM fr GROUP BY series)"""
KNOWN = LAGS + """, kn AS (SELECT fr.*, lag_days, CASE WHEN release_date > DATE '1997-02-04' THEN release_date ELSE obs_date + floor(lag_days)::INT END AS known_on FROM fr JOIN lag USING (series))"""
COLLAPSED = KNOWN + ", co AS (SELECT series, known_on, max_by(value, obs_date) AS value, max(obs_date) AS obs_date FROM kn WHERE value IS NOT NULL GROUP BY ALL)"


def _known(spark, d):
    first = pit.first_release(vintages(spark, d))
    lags = pit.release_lag(first, 30)
    return first, lags, pit.known_on(first, lags)


@query("first_release", f"WITH {FIRST} SELECT * FROM fr")
def _(spark, d):
    return pit.first_release(vintages(spark, d))


@query("release_lag", f"WITH {LAGS} SELECT * FROM lag")
def _(spark, d):
    return _known(spark, d)[1]


@query("known_on", f"WITH {KNOWN} SELECT series, obs_date, release_date, value, lag_days, known_on FROM kn")
def _(spark, d):
    return _known(spark, d)[2]


@query("collapse_same_day", f"WITH {COLLAPSED} SELECT * FROM co")
def _(spark, d):
    return pit.collapse_same_day(_known(spark, d)[2])


@query("extend_pre_vintage", f"""WITH {COLLAPSED}, plain AS (SELECT series, obs_date, max(value) AS value FROM vint GROUP BY ALL), late AS (SELECT * FROM co WHERE known_on >= DATE '1996-01-01'),
  st AS (SELECT series, min(known_on) AS f FROM late GROUP BY series), early AS (SELECT series, obs_date + floor(lag_days)::INT AS known_on, obs_date, value FROM plain JOIN lag USING (series)),
  u AS (SELECT series, known_on, obs_date, value FROM late UNION ALL SELECT series, known_on, obs_date, value FROM early JOIN st USING (series) WHERE known_on < f)
  SELECT series, known_on, max_by(value, obs_date) AS value, max(obs_date) AS obs_date FROM u WHERE value IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    _, lags, known = _known(spark, d)
    plain = vintages(spark, d).groupBy("series", "obs_date").agg(F.max("value").alias("value"))
    return pit.extend_pre_vintage(pit.collapse_same_day(known).filter("known_on >= DATE'1996-01-01'"), plain, lags, 30)


@query("splice_series", f"""WITH {MACRO}, p AS (SELECT ent AS series, t, v AS value FROM macro WHERE t >= DATE '1995-06-01'), h AS (SELECT ent AS series, t, v / 3 + day(t) AS value FROM macro WHERE ent <> '1-URGENT' OR t < DATE '1995-06-10'),
  r AS (SELECT series, CASE WHEN count(*) >= 20 THEN median(p.value / h.value) END AS r FROM p JOIN h USING (series, t) GROUP BY series), s AS (SELECT series, min(t) AS st FROM p GROUP BY series)
  SELECT series, t, round(value, 6) AS value FROM p UNION ALL SELECT h.series, h.t, round(h.value * coalesce(r, 1.0), 6) FROM h JOIN s USING (series) LEFT JOIN r USING (series) WHERE t < st""")
def _(spark, d):
    m = macro_panel(spark, d).select(F.col("ent").alias("series"), "t", F.col("v").alias("value"))
    old = m.filter("series <> '1-URGENT' OR t < DATE'1995-06-10'").withColumn("value", F.col("value") / 3 + F.dayofmonth("t"))
    return rounded(pit.splice_series(m.filter("t >= DATE'1995-06-01'"), old))


@query("build_calendar", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS t FROM lineitem UNION SELECT CAST(o_orderdate AS DATE) FROM orders")
def _(spark, d):
    a = spark.read.parquet(f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias("t"))
    return pit.build_calendar(a, spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("t")))


@query("shift_publication", f"WITH {MACRO} SELECT ent AS series, CASE WHEN ent = '5-LOW' THEN t + 5 ELSE t END AS t, v FROM macro")
def _(spark, d):
    m = macro_panel(spark, d).select(F.col("ent").alias("series"), "t", "v")
    rules = m.select("series").distinct().select("series", F.when(F.col("series") == "5-LOW", "lag").otherwise("close").alias("rule"), F.lit(5).alias("lag_days"))
    return pit.shift_publication(m, rules)


ALIGN = MACRO + f""", {PX}, cal AS (SELECT ent, t FROM (SELECT DISTINCT ent FROM macro), (SELECT DISTINCT t FROM px)), sp AS (SELECT * FROM macro WHERE (t - DATE '1970-01-01') % 10 < 3),
  al AS (SELECT cal.ent, cal.t, CASE WHEN cal.t - sp.t <= 5 THEN sp.v END AS value, cal.t - sp.t AS age_days FROM cal ASOF LEFT JOIN sp ON cal.ent = sp.ent AND cal.t >= sp.t)"""


def _aligned(spark, d):
    m = macro_panel(spark, d)
    cal = m.select("ent").distinct().join(price_panel(spark, d).select("t").distinct(), how="cross")  # five series by days
    return pit.asof_align(m.filter("pmod(unix_date(t), 10) < 3"), cal, 5, ENT, T, "v").withColumnRenamed("v", "value")


@query("asof_align", f"WITH {ALIGN} SELECT ent, t, value, age_days FROM al")
def _(spark, d):
    return _aligned(spark, d)


@query("assemble_wide", f"""WITH {ALIGN} SELECT t, max(value) FILTER (ent = '1-URGENT') AS "1-URGENT", max(value) FILTER (ent = '5-LOW') AS "5-LOW" FROM al GROUP BY t""")
def _(spark, d):
    return pit.assemble_wide(_aligned(spark, d).withColumnRenamed("ent", "series"), ["1-URGENT", "5-LOW"], [])


@query("merge_sources_left", f"WITH {PX}, m AS (SELECT CAST(o_orderdate AS DATE) AS t, count(*) AS n_orders FROM orders GROUP BY 1) SELECT t, ent, px, n_orders FROM px LEFT JOIN m USING (t)")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderdate").alias("t")).agg(F.count(F.lit(1)).alias("n_orders"))
    return pit.merge_sources_left(price_panel(spark, d).select("ent", "t", "px"), orders)


@query("prefer_column", f"""WITH {HOLES}, c AS (SELECT ent, count(CASE WHEN ent <> 'A' THEN px END) AS n FROM holes GROUP BY ent)
  SELECT ent, t, CASE WHEN n > 0 THEN CASE WHEN ent <> 'A' THEN px END ELSE qty END AS best FROM holes JOIN c USING (ent)""")
def _(spark, d):
    from tidemark.operators.features import prefer_column

    holes = holes_panel(spark, d).withColumn("px", F.when(F.col("ent") != "A", F.col("px")))
    return prefer_column(holes, ["missing", "px", "qty"], ENT, "best").select("ent", "t", "best")


def _cover_sql(table, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min(CASE WHEN {c} IS NOT NULL THEN t END) AS first_date, max(CASE WHEN {c} IS NOT NULL THEN t END) AS last_date FROM {table}" for c in cols)


@query("coverage_report", f"WITH {HOLES} {_cover_sql('holes', ['px', 'qty', 'disc'])}")
def _(spark, d):
    return pit.coverage_report(holes_panel(spark, d), ["px", "qty", "disc"])


@query("coverage_delta", f"""WITH {HOLES}, b AS ({_cover_sql('holes', ['px', 'qty'])}), a AS ({_cover_sql('px', ['px', 'qty', 'disc'])})
  SELECT "column", coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS gained FROM b FULL JOIN a USING ("column")""")
def _(spark, d):
    return pit.coverage_delta(pit.coverage_report(holes_panel(spark, d), ["px", "qty"]), pit.coverage_report(price_panel(spark, d), ["px", "qty", "disc"]))


COLS = ["px", "qty", "disc", "tax"]
RANGES = {"px": (20000.0, 60000.0), "qty": (None, 300.0), "disc": (2.0, None), "tax": (1.0, 7.0)}
MISSING = HOLES + ", ms AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS pct, count(*) AS n FROM holes" for c in COLS) + ")"
BROKEN = [(c, b, x, "<" if b == "min" else ">") for c, lh in RANGES.items() for b, x in zip(("min", "max"), lh) if x is not None]
VIOLATED = "vi AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{b}' AS bound, {x}::DOUBLE AS \"limit\", count(*) FILTER ({c} {op} {x}) AS n FROM holes" for c, b, x, op in BROKEN) + ") WHERE n > 0)"
SCORE = f"{MISSING}, {VIOLATED}, sc AS (SELECT 0.6::DOUBLE * greatest(0, 1 - (SELECT sum(n_missing) * 100.0::DOUBLE / sum(n) FROM ms) / 100) + 0.4::DOUBLE * greatest(0, 1 - (SELECT count(*) FROM vi)::DOUBLE / (SELECT sum(n) FROM ms)) AS score)"


@query("missing_stats", f"""WITH {MISSING} SELECT "column", n_missing, round(pct, 6) AS pct, pct > 5 AS critical, (sum(n_missing) OVER ())::BIGINT AS total_missing,
  round(sum(n_missing) OVER () * 100.0::DOUBLE / sum(n) OVER (), 6) AS overall_pct FROM ms""")
def _(spark, d):
    return rounded(clean.missing_stats(holes_panel(spark, d), COLS))


@query("range_violations", f"WITH {HOLES}, {VIOLATED} SELECT * FROM vi")
def _(spark, d):
    return clean.range_violations(holes_panel(spark, d), RANGES)


FILL = HOLES + """, r AS (SELECT ent, t, row_number() OVER w AS pos, px, qty FROM holes WINDOW w AS (PARTITION BY ent ORDER BY t)),
  n AS (SELECT ent, t, pos, last_value(px IGNORE NULLS) OVER up AS px, qty, last_value(CASE WHEN qty IS NOT NULL THEN pos END IGNORE NULLS) OVER up AS pa, last_value(qty IGNORE NULLS) OVER up AS va,
    first_value(CASE WHEN qty IS NOT NULL THEN pos END IGNORE NULLS) OVER dn AS pb, first_value(qty IGNORE NULLS) OVER dn AS vb FROM r
    WINDOW up AS (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING), dn AS (PARTITION BY ent ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  i AS (SELECT ent, t, px, CASE WHEN qty IS NOT NULL THEN qty WHEN pb IS NULL THEN va WHEN pa IS NOT NULL THEN va + (vb - va) * (pos - pa) / (pb - pa) END AS qty FROM n)"""


@query("fill_missing", f"""WITH {FILL} SELECT ent, t, first_value(px IGNORE NULLS) OVER dn AS px, round(first_value(qty IGNORE NULLS) OVER dn, 6) AS qty FROM i
  WINDOW dn AS (PARTITION BY ent ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(spark, d):
    return clean.fill_missing(holes_panel(spark, d).select("ent", "t", "px", "qty"), ["px"], ["qty"], ENT, T).withColumn("qty", F.round("qty", 6))


@query("quality_score", f"WITH {SCORE} SELECT round(score, 6) AS score FROM sc")
def _(spark, d):
    return rounded(clean.quality_score(holes_panel(spark, d), COLS, RANGES))


@query("validate_frame", f"""WITH {SCORE} SELECT count(*) AS n_rows, 4 AS n_columns, min(t) AS first_date, max(t) AS last_date, (SELECT sum(n_missing)::BIGINT FROM ms) AS total_missing,
  (SELECT round(sum(n_missing) * 100.0::DOUBLE / sum(n), 6) FROM ms) AS overall_pct, (SELECT count(*) FROM vi) AS n_violations, (SELECT round(score, 6) FROM sc) AS score FROM holes""")
def _(spark, d):
    return rounded(clean.validate_frame(holes_panel(spark, d), COLS, RANGES, T))


@query("legacy_clean", f"""WITH {HOLES}, f AS (SELECT ent, t, last_value(px IGNORE NULLS) OVER up AS px, last_value(qty IGNORE NULLS) OVER up AS qty FROM holes WINDOW up AS (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT ent, t, px, coalesce(qty, first_value(qty IGNORE NULLS) OVER (PARTITION BY ent ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qty FROM f)
  SELECT ent, t, round(coalesce(px, avg(px) OVER (PARTITION BY ent)), 6) AS px, round(coalesce(qty, avg(qty) OVER (PARTITION BY ent)), 6) AS qty FROM b""")
def _(spark, d):
    return rounded(clean.legacy_clean(holes_panel(spark, d).select("ent", "t", "px", "qty"), ["px", "qty"], "px", ENT, T))


@query("proxy_columns", f"""WITH {PX} SELECT ent, t, round(100.0::DOUBLE / (tax + 1), 6) AS margin_debt, round(1 + greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.5::DOUBLE * (qty / lag(qty) OVER w - 1))) + 0 * lag(qty) OVER w, 6) AS put_call_ratio
  FROM px WINDOW w AS (PARTITION BY ent ORDER BY t)""")
def _(spark, d):
    return rounded(clean.proxy_columns(price_panel(spark, d), "tax", "qty", ENT, T).select("ent", "t", "margin_debt", "put_call_ratio"))


LONG = "lg AS (" + " UNION ALL ".join(f"SELECT ent, '{c}' AS \"column\", t, {c}::DOUBLE AS v FROM src WHERE {c} IS NOT NULL" for c in ("px", "qty", "n")) + ")"
RUNS = LONG + """, r1 AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS nw, lag(v) OVER w AS prev FROM lg WINDOW w AS (PARTITION BY ent, "column" ORDER BY t)),
  r2 AS (SELECT *, sum(nw) OVER (PARTITION BY ent, "column" ORDER BY t) AS run FROM r1),
  rn AS (SELECT ent, "column", max(n) AS longest_run FROM (SELECT ent, "column", run, count(*) AS n FROM r2 GROUP BY ALL) GROUP BY ALL)"""
SCREEN = f"""{PX}, src AS (SELECT ent, t, px, qty, n FROM px), {RUNS}, st AS (SELECT ent, "column", count(v) AS n_obs, min(t) AS first_valid, max(t) AS last_valid, corr(v, prev) AS autocorr, stddev_samp(v) / avg(abs(v)) AS rel_std FROM r1 GROUP BY ALL),
  vd AS (SELECT *, CASE WHEN "column" = 'n' AND false THEN 'quarantined' WHEN n_obs < 252 THEN 'too_short' WHEN longest_run > 0.10::DOUBLE * n_obs THEN 'constant_fill' WHEN coalesce(rel_std, 0) < 1e-6 THEN 'no_variation'
    WHEN autocorr < 0.3 AND rel_std > 0 AND rel_std < 0.05 THEN 'implausible_noise' ELSE 'ok' END AS verdict FROM st JOIN rn USING (ent, "column"))"""


@query("longest_constant_run", f'WITH {PX}, src AS (SELECT ent, t, px, qty, n FROM px), {RUNS} SELECT ent, "column", longest_run FROM rn')
def _(spark, d):
    return clean.longest_constant_run(price_panel(spark, d), ["px", "qty", "n"], ENT, T)


@query("screen_columns", f"""WITH {SCREEN} SELECT ent, "column", n_obs, first_valid, last_valid, round(autocorr, 6) AS autocorr, round(rel_std, 6) AS rel_std, longest_run, verdict,
  CASE WHEN verdict <> 'ok' THEN format('{{}}: n={{}} run={{}}', verdict, n_obs, longest_run) END AS reason FROM vd""")
def _(spark, d):
    return rounded(clean.screen_columns(price_panel(spark, d), ["px", "qty", "n"], ENT, T))


def _flat(spark, d):
    """The price panel with a fabricated column beside the real ones."""
    return price_panel(spark, d).select("ent", "t", "px", "qty", F.when(F.year("t") < 1996, 17.24).otherwise(F.col("tax")).alias("flat"))


@query("apply_screen", f"WITH {PX} SELECT ent, t, px, qty FROM px")
def _(spark, d):
    df = _flat(spark, d)
    return clean.apply_screen(df, clean.screen_columns(df, ["px", "qty", "flat"], ENT, T))


@query("rejected_columns", f"""WITH {PX}, src AS (SELECT ent, t, px, qty, CASE WHEN year(t) < 1996 THEN 17.24 ELSE tax END AS n FROM px), {RUNS}, c AS (SELECT ent, "column", count(*) AS n_obs FROM lg GROUP BY ALL)
  SELECT ent, 'flat' AS "column", format('constant_fill: n={{}} run={{}}', n_obs, longest_run) AS reason FROM rn JOIN c USING (ent, "column") WHERE "column" = 'n'""")
def _(spark, d):
    return clean.screen_columns(_flat(spark, d), ["px", "qty", "flat"], ENT, T).filter("verdict <> 'ok'").select("ent", "column", "reason")


@query("resolve_price", f"WITH {PX} SELECT ent, 'px' AS \"column\", count(px) AS n_obs FROM px GROUP BY ent")
def _(spark, d):
    return clean.resolve_price(_flat(spark, d), ["flat", "px", "qty"], ENT, T)
