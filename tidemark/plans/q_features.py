"""Queries of window features, labels and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows as wf
from tidemark.functions.rolling import Rolled, rolled
from tidemark.operators import episodes, features, labels
from tidemark.plans.panels import ENT, POS, PX, RAW, T, forward_sql, price_panel, raw_panel, rounded

QUERIES, SQL = {}, {}
W = "(PARTITION BY ent ORDER BY t)"


def last(n: int) -> str:
    return f"(PARTITION BY ent ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, mp: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {last(n)} >= {n if mp is None else mp} THEN {agg}({x}) OVER {last(n)} END"


def z(x: str) -> str:
    w = "(PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} >= 252 THEN ({x} - avg({x}) OVER {w}) / nullif(stddev_samp({x}) OVER {w}, 0) END"


def pct(x: str, k: int) -> str:
    return f"({x} / nullif(lag({x}, {k}) OVER {W}, 0) - 1)"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def simple(name, sql_expr, build, digits=6, ctes=PX, source="px"):
    """A query that adds one column `v` to the price panel's keys."""
    SQL[name] = f"WITH {ctes} SELECT ent, t, round({sql_expr}, {digits}) AS v FROM {source}"
    QUERIES[name] = lambda spark, d: rounded(build(price_panel(spark, d)).select("ent", "t", "v"), digits)


RET = PX + f", rt AS (SELECT *, {pct('px', 1)} AS r, {pct('qty', 1)} AS rq, row_number() OVER {W} AS pos FROM px)"


def _ret(df):
    return df.withColumns({"r": wf.pct_change("px", 1, ENT, T), "rq": wf.pct_change("qty", 1, ENT, T)})


simple("pct_change", pct("px", 5), lambda df: df.withColumn("v", wf.pct_change("px", 5, ENT, T)))
simple("diff", f"px - lag(px, 20) OVER {W}", lambda df: df.withColumn("v", wf.diff("px", 20, ENT, T)))
simple("rolling", roll("stddev_samp", "px", 63, 40), lambda df: rolled(df, {"v": Rolled("std", "px", 63, 40)}, ENT, T))
simple("expanding_z", z("px"), lambda df: df.withColumn("v", wf.expanding_z("px", ENT, T)))
simple("rolling_skew", roll("skewness", "r", 63), lambda df: rolled(_ret(df), {"v": Rolled("skew", "r", 63)}, ENT, T), 3, RET, "rt")
simple("rolling_kurt", roll("kurtosis", "r", 63), lambda df: rolled(_ret(df), {"v": Rolled("kurt", "r", 63)}, ENT, T), 3, RET, "rt")
simple("rolling_acf", f"CASE WHEN count(r) OVER {last(63)} = 63 THEN corr(r, rl) OVER {last(53)} END", lambda df: rolled(_ret(df), {"v": Rolled("acf", "r", 63, lag=10)}, ENT, T), 6,
       RET + f", ra AS (SELECT *, lag(r, 10) OVER {W} AS rl FROM rt)", "ra")
simple("rolling_corr", f"CASE WHEN count(CASE WHEN r IS NOT NULL AND rq IS NOT NULL THEN 1 END) OVER {last(63)} >= 63 THEN corr(r, rq) OVER {last(63)} END",
       lambda df: rolled(_ret(df), {"v": Rolled("corr", "r", 63, other="rq")}, ENT, T), 6, RET, "rt")
simple("days_since_max", f"CASE WHEN count(px) OVER {last(252)} = 252 THEN pos - arg_max(pos, px) OVER {last(252)} END::DOUBLE", lambda df: rolled(df, {"v": Rolled("since_max", "px", 252)}, ENT, T), 6, RET, "rt")
simple("annualised_vol_pct", roll("stddev_samp", "r", 20) + " * sqrt(252) * 100", lambda df: _ret(df).withColumn("v", wf.annualised_vol_pct("r", ENT, T)), 6, RET, "rt")
simple("drawdown_from_ath", f"(px / max(px) OVER (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING) - 1) * 100", lambda df: df.withColumn("v", wf.drawdown_from_ath("px", ENT, T)))


@query("log_returns", f"WITH {RET} SELECT ent, t, round(ln(px / lag(px) OVER {W}), 6) AS log_return FROM rt QUALIFY pos > 1")
def _(spark, d):
    return rounded(wf.log_returns(price_panel(spark, d), "px", ENT, T).select("ent", "t", "log_return"))


@query("roc_columns", f"WITH {PX} SELECT ent, t, " + ", ".join(f"round({pct('px', k)} * 100, 6) AS px_roc_{k}" for k in (1, 5, 20)) + " FROM px")
def _(spark, d):
    return rounded(wf.roc_columns(price_panel(spark, d), "px", ENT, T).select("ent", "t", "px_roc_1", "px_roc_5", "px_roc_20"))


def chained(levels: list[dict[str, str]], source: str) -> tuple[str, str]:
    """One CTE per level of helper columns over `source`, and the name of the last."""
    ctes, at = "", source
    for i, level in enumerate(levels):
        ctes += f", {source}_{i} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in level.items()) + f" FROM {at})"
        at = f"{source}_{i}"
    return ctes, at


def staged(levels: list[dict[str, str]], out: dict[str, str], digits: dict[str, int], source: str = "raw") -> str:
    """SQL with one CTE per level of helper columns, then the rounded output."""
    ctes, at = RAW, source
    for i, level in enumerate(levels):
        ctes += f", lv{i} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in level.items()) + f" FROM {at})"
        at = f"lv{i}"
    return f"WITH {ctes} SELECT ent, t, " + ", ".join(f"round({e}::DOUBLE, {digits.get(c, 6)}) AS {c}" for c, e in out.items()) + f" FROM {at}"


P = "sp500_close"
MATH_LEVELS = [
    {"_r": pct(P, 1), "_pos": f"row_number() OVER {W}"},
    {"_v21": roll("stddev_samp", "_r", 21) + " * sqrt(252)", "_v63": roll("stddev_samp", "_r", 63) + " * sqrt(252)", "_v252": roll("stddev_samp", "_r", 252) + " * sqrt(252)", "_ar": "abs(_r)",
     "_rl10": f"lag(_r, 10) OVER {W}", "_rl20": f"lag(_r, 20) OVER {W}", "_neg": "CASE WHEN _r < 0 THEN _r END", "_posr": "CASE WHEN _r > 0 THEN _r END"},
    {"_atr": roll("avg", "_ar", 21)},
]
MATH_OUT = {
    "rv_21_z": z("_v21"), "rv_63_z": z("_v63"), "rv_252_z": z("_v252"), "skew_63": roll("skewness", "_r", 63), "kurt_63": roll("kurtosis", "_r", 63),
    "dd_from_252h": f"({P} / ({roll('max', P, 252)}) - 1) * 100", "days_since_252h": f"CASE WHEN count({P}) OVER {last(252)} = 252 THEN _pos - arg_max(_pos, {P}) OVER {last(252)} END",
    "acf_10": f"CASE WHEN count(_r) OVER {last(63)} = 63 THEN corr(_r, _rl10) OVER {last(53)} END", "acf_20": f"CASE WHEN count(_r) OVER {last(126)} = 126 THEN corr(_r, _rl20) OVER {last(106)} END",
    "range_atr_z": z("_atr"), "iv_rv_gap": "vix_close / 100 - _v21", "return_dispersion_63": roll("stddev_samp", "_r", 63),
    "downside_vol_ratio_63": f"({roll('stddev_samp', '_neg', 63, 15)}) / nullif({roll('stddev_samp', '_posr', 63, 15)}, 0)",
}
DIGITS = {"skew_63": 3, "kurt_63": 3}


@query("features_math", staged(MATH_LEVELS, MATH_OUT, DIGITS))
def _(spark, d):
    out = features.features_math(raw_panel(spark, d), P, ENT, T).select("ent", "t", *features.MATH)
    return out.select("ent", "t", *[F.round(c, DIGITS.get(c, 6)).alias(c) for c in features.MATH])


MACRO_LEVELS = [
    {"_ue": roll("avg", "unemployment_rate", 63), "_cl": pct("initial_claims", 65), "_m2": pct("m2_money_supply", 252), "_ma": roll("avg", P, 2520, 1260), "_cp": pct("cpi", 252)},
    {"_cape": f"{P} / nullif(_ma, 0)"},
]
MACRO_OUT = {
    "yc_10y_3m": "yield_10y_3m", "yc_10y_2y": "yield_10y_2y", "yc_10y_3m_chg": f"yield_10y_3m - lag(yield_10y_3m, 20) OVER {W}", "hy_spread_z": z("hy_spread"),
    "hy_spread_chg": f"hy_spread - lag(hy_spread, 20) OVER {W}", "ig_spread_z": z("baa_10y_spread"), "nfci_level": "nfci", "nfci_chg": f"nfci - lag(nfci, 20) OVER {W}",
    "nfci_leverage_level": "NULL", "nfci_credit_level": "NULL", "stlfsi_z": "NULL", "epu_z": "NULL", "sahm_indicator": f"_ue - ({roll('min', '_ue', 252)})", "claims_13w_chg_z": z("_cl"),
    "cape_proxy_z": z("_cape"), "m2_yoy_z": z("_m2"), "real_rate_10y": "yield_10y - _cp * 100",
}


@query("features_macro", staged(MACRO_LEVELS, MACRO_OUT, {}))
def _(spark, d):
    return rounded(features.features_macro(raw_panel(spark, d), P, ENT, T).select("ent", "t", *features.MACRO))


OPTION_LEVELS = [{"_j": pct("vix_close", 5)}]
OPTION_OUT = {"vix_z": z("vix_close"), "vix_shock_5d": z("_j"), "vix_term_structure": "vix_close / nullif(vxv_close, 0)"}


@query("features_options", staged(OPTION_LEVELS, OPTION_OUT, {}))
def _(spark, d):
    return rounded(features.features_options(raw_panel(spark, d), ENT, T).select("ent", "t", *features.OPTIONS))


BREADTH_LEVELS = [
    {"_m50": roll("avg", P, 50), "_m200": roll("avg", P, 200), "_pr": pct(P, 1), "_up": "bool_and(coalesce(-yield_10y > 0, false)) OVER (PARTITION BY ent)"},
    {"_br": f"CASE WHEN _up THEN yield_10y / nullif(lag(yield_10y) OVER {W}, 0) - 1 ELSE lag(yield_10y) OVER {W} - yield_10y END"},
    {"_co": f"CASE WHEN count(CASE WHEN _pr IS NOT NULL AND _br IS NOT NULL THEN 1 END) OVER {last(63)} >= 63 THEN corr(_pr, _br) OVER {last(63)} END"},
]
BREADTH_OUT = {
    "ma50_dist": f"({P} / nullif(_m50, 0) - 1) * 100", "ma200_dist": f"({P} / nullif(_m200, 0) - 1) * 100", "ma50_above_ma200": "coalesce(_m50 > _m200, false)::INT",
    "cross_asset_corr_z": z("_co"), "dxy_z": z("dollar_twi"),
}


@query("features_breadth", staged(BREADTH_LEVELS, BREADTH_OUT, {}))
def _(spark, d):
    return rounded(features.features_breadth(raw_panel(spark, d), P, ENT, T).select("ent", "t", *features.BREADTH))


GEO_LEVELS = [{"_oil": pct("oil_wti", 21)}]


@query("features_geo", staged(GEO_LEVELS, {"oil_shock_z": z("_oil")}, {}))
def _(spark, d):
    return rounded(features.features_geo(raw_panel(spark, d), ENT, T).select("ent", "t", "oil_shock_z"))


ALL_LEVELS = MATH_LEVELS + MACRO_LEVELS + OPTION_LEVELS + BREADTH_LEVELS + GEO_LEVELS
ALL_OUT = {c.removesuffix("_level"): e for c, e in (MATH_OUT | MACRO_OUT | OPTION_OUT | BREADTH_OUT | {"oil_shock_z": z("_oil")}).items()}


@query("build_features", staged(ALL_LEVELS, {"_price": P} | ALL_OUT, DIGITS))
def _(spark, d):
    out = features.build_features(raw_panel(spark, d), ENT, T)
    return out.select("ent", "t", *[F.round(c, DIGITS.get(c, 6)).alias(c) for c in ["_price", *features.FEATURES]])


COVERED = list(ALL_OUT)


@query("feature_coverage", "WITH f AS (" + staged(ALL_LEVELS, {c: ALL_OUT[c] for c in COVERED}, {}) + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n_obs, min(CASE WHEN {c} IS NOT NULL THEN t END) AS first_valid, round(count({c}) * 100.0::DOUBLE / count(*), 1) AS pct FROM f" for c in COVERED))
def _(spark, d):
    return features.feature_coverage(features.build_features(raw_panel(spark, d), ENT, T), COVERED, T).withColumn("pct", F.col("pct").cast("double"))


@query("forward_maxdd", f"WITH {PX}, {POS}, {forward_sql(21)} SELECT ent, t, round(dd, 6) AS fwd_maxdd FROM fw")
def _(spark, d):
    return rounded(labels.forward_maxdd(price_panel(spark, d), "px", 21, ENT, T).select("ent", "t", "fwd_maxdd"))


@query("crash_label", f"WITH {PX}, {POS}, {forward_sql(63)} SELECT ent, t, CASE WHEN dd IS NOT NULL THEN (dd >= 80)::INT::DOUBLE END AS y FROM fw")
def _(spark, d):
    return labels.forward_maxdd(price_panel(spark, d), "px", 63, ENT, T).select("ent", "t", labels.crash_label("fwd_maxdd", 80.0).alias("y"))


GRID = "(VALUES (60.0), (75.0), (85.0)) AS g(x)"


@query("label_coverage", f"""WITH {PX}, {POS}, {forward_sql(21, 'f21')}, {forward_sql(63, 'f63')}, u AS (SELECT ent, dd, 21 AS h FROM f21 UNION ALL SELECT ent, dd, 63 FROM f63)
  SELECT ent, x::DOUBLE AS x_pct, h AS horizon, count(*) AS n_dates, count(dd) AS n_scorable, sum((dd >= x)::INT)::BIGINT AS n_positive, round(sum((dd >= x)::INT)::DOUBLE / count(dd), 6) AS base_rate
  FROM u, {GRID} GROUP BY ALL""")
def _(spark, d):
    return rounded(labels.label_coverage(price_panel(spark, d), "px", [60, 75, 85], [21, 63], ENT, T))


TIER = "CASE WHEN {0} < 5 THEN 'micro' WHEN {0} < 10 THEN 'minor' WHEN {0} < 15 THEN 'moderate' WHEN {0} < 20 THEN 'major' WHEN {0} < 30 THEN 'severe' ELSE 'extreme' END"
EPISODES = PX + f""", b AS (SELECT ent, t, px AS p, row_number() OVER {W} AS pos, max(px) OVER {last(252)} AS hi, count(*) OVER (PARTITION BY ent) AS n FROM px),
  op AS (SELECT ent, pos AS i, hi FROM b WHERE n >= 252 AND p / hi - 1 <= -0.6::DOUBLE),
  pk AS (SELECT op.ent, i, max(b.pos) AS peak FROM op JOIN b ON b.ent = op.ent AND b.pos <= i AND b.p >= op.hi GROUP BY ALL),
  en AS (SELECT pk.ent, i, peak, x.p AS pp, min(y.pos) AS fin FROM pk JOIN b x ON x.ent = pk.ent AND x.pos = peak LEFT JOIN b y ON y.ent = pk.ent AND y.pos > i AND y.p >= x.p GROUP BY ALL),
  nx AS (SELECT en.ent, en.i, peak, pp, fin, min(op.i) AS nxt FROM en LEFT JOIN op ON op.ent = en.ent AND op.i > fin GROUP BY ALL),
  ep AS (SELECT nx.* FROM nx JOIN (SELECT ent, min(i) AS i FROM op GROUP BY ent) f ON f.ent = nx.ent AND f.i = nx.i UNION ALL SELECT nx.* FROM ep JOIN nx ON nx.ent = ep.ent AND nx.i = ep.nxt),
  tr AS (SELECT ep.ent, ep.i, peak, pp, fin, min(b.p) AS tp, arg_min(b.pos, (b.p, b.pos)) AS trough FROM ep JOIN b ON b.ent = ep.ent AND b.pos BETWEEN ep.i AND coalesce(fin, b.n) GROUP BY ALL)"""


@query("drawdown_episodes", f"""WITH RECURSIVE {EPISODES} SELECT tr.ent, a.t AS peak_date, round(pp, 6) AS peak_price, c.t AS trough_date, round(tp, 6) AS trough_price, r.t AS recovery_date, round((1 - tp / pp) * 100, 6) AS drawdown_pct,
  trough - peak AS duration_to_trough_td, fin - trough AS duration_to_recovery_td, {TIER.format('((1 - tp / pp) * 100)')} AS severity_tier
  FROM tr JOIN b a ON a.ent = tr.ent AND a.pos = peak JOIN b c ON c.ent = tr.ent AND c.pos = trough LEFT JOIN b r ON r.ent = tr.ent AND r.pos = fin WHERE trough - peak >= 5""")
def _(spark, d):
    return rounded(episodes.drawdown_episodes(price_panel(spark, d), "px", 60.0, ENT, T))


TIERS = "CASE WHEN dd < 5 THEN 'micro' WHEN dd < 10 THEN 'minor' WHEN dd < 15 THEN 'moderate' WHEN dd < 20 THEN 'major' WHEN dd < 30 THEN 'severe' ELSE 'extreme' END"


@query("severity_tier", f"WITH {PX}, d AS (SELECT ent, t, (1 - px / max(px) OVER (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING)) * 100 AS dd FROM px) SELECT ent, t, {TIERS} AS tier FROM d")
def _(spark, d):
    return price_panel(spark, d).withColumn("dd", -wf.drawdown_from_ath("px", ENT, T)).select("ent", "t", episodes.severity_tier("dd").alias("tier"))


CRASH = PX + f""", c1 AS (SELECT ent, t, px AS p, max(px) OVER (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING) AS hi, count(*) OVER (PARTITION BY ent) AS n FROM px),
  c2 AS (SELECT *, (p / hi - 1) * 100 <= -40 AS cr FROM c1 WHERE n >= 100),
  c3 AS (SELECT *, cr AND NOT coalesce(lag(cr) OVER {W}, false) AS en, last_value(CASE WHEN p = hi THEN t END IGNORE NULLS) OVER up AS pk, last_value(CASE WHEN p = hi THEN p END IGNORE NULLS) OVER up AS pp
    FROM c2 WINDOW up AS (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING)),
  c4 AS (SELECT *, sum(en::INT) OVER (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c3),
  c5 AS (SELECT ent, run, min(pk) AS start_date, min(pp) AS peak_price, min(p) AS trough_price, arg_min(t, (p, t)) AS trough_date, max(t) AS last_in FROM c4 WHERE cr GROUP BY ent, run),
  c6 AS (SELECT c5.*, (SELECT min(t) FROM c1 WHERE c1.ent = c5.ent AND c1.t > c5.last_in AND c1.p >= c5.peak_price) AS recovery_date FROM c5),
  cr AS (SELECT ent, start_date, trough_date, recovery_date, peak_price, trough_price, (1 - trough_price / peak_price) * 100 AS max_drawdown, recovery_date - trough_date AS recovery_days FROM c6 WHERE trough_date - start_date >= 5)"""


def _crashes(spark, d):
    return episodes.threshold_crashes(price_panel(spark, d), "px", ENT, T, 40.0)


@query("threshold_crashes", f"WITH {CRASH} SELECT ent, start_date, trough_date, recovery_date, round(peak_price, 6) AS peak_price, round(trough_price, 6) AS trough_price, round(max_drawdown, 6) AS max_drawdown, recovery_days FROM cr")
def _(spark, d):
    return rounded(_crashes(spark, d))


DEDUPED = CRASH + ", de AS (SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY ent, start_date, trough_date ORDER BY max_drawdown DESC, recovery_date NULLS LAST) = 1)"
KIND = "CASE WHEN max_drawdown >= 30 THEN 'Extreme' WHEN max_drawdown >= 20 THEN 'Severe' WHEN max_drawdown >= 15 THEN 'Major' WHEN max_drawdown >= 10 THEN 'Moderate' ELSE 'Minor' END"
EVENTS = DEDUPED + f", ev AS (SELECT *, coalesce(recovery_date, trough_date) AS end_date, CASE WHEN recovery_days <> 0 THEN recovery_days // 30 END AS recovery_months, {KIND} AS crash_type FROM de)"


@query("dedupe_crashes", f"WITH {DEDUPED} SELECT ent, start_date, trough_date, recovery_date, round(max_drawdown, 6) AS max_drawdown FROM de")
def _(spark, d):
    return rounded(episodes.dedupe_crashes(_crashes(spark, d), ENT).select("ent", "start_date", "trough_date", "recovery_date", "max_drawdown"))


def _events(spark, d):
    return episodes.crash_events(episodes.dedupe_crashes(_crashes(spark, d), ENT), ENT)


@query("crash_events", f"""WITH {EVENTS} SELECT ent, start_date, end_date, trough_date, recovery_date, round(max_drawdown, 6) AS max_drawdown, recovery_months::BIGINT AS recovery_months, crash_type,
  printf('%s drawdown of %.1f%%', crash_type, max_drawdown) AS notes FROM ev""")
def _(spark, d):
    return rounded(_events(spark, d))


@query("crash_summary", f"WITH {EVENTS} SELECT crash_type, count(*) AS n, round(max(max_drawdown), 6) AS deepest, list_position(['Minor', 'Moderate', 'Major', 'Severe', 'Extreme'], crash_type)::BIGINT AS rank FROM ev GROUP BY crash_type")
def _(spark, d):
    return rounded(episodes.crash_summary(_events(spark, d)))


@query("normal_days", f"""WITH {CRASH}, iv AS (SELECT ent, start_date AS a, coalesce(recovery_date, trough_date) AS b FROM cr WHERE trough_price < peak_price * 0.25),
  days AS (SELECT unnest(generate_series(DATE '1985-01-01', DATE '2015-01-01', INTERVAL 1 DAY))::DATE AS d),
  bd AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM days WHERE isodow(d) < 6),
  lo AS (SELECT d.d, (SELECT max(k) FROM bd WHERE bd.d <= d.d) - 20 AS k FROM days d), hi AS (SELECT d.d, (SELECT min(k) FROM bd WHERE bd.d >= d.d) + 20 AS k FROM days d),
  w AS (SELECT iv.ent, x.d AS a, y.d AS b FROM iv JOIN lo ON lo.d = iv.a JOIN hi ON hi.d = iv.b JOIN bd x ON x.k = lo.k JOIN bd y ON y.k = hi.k)
  SELECT ent, t, NOT EXISTS (SELECT 1 FROM w WHERE w.ent = px.ent AND px.t BETWEEN w.a AND w.b) AS normal FROM px""")
def _(spark, d):
    found = _crashes(spark, d).filter("trough_price < peak_price * 0.25").select("ent", F.col("start_date").alias("peak_date"), "trough_date", "recovery_date")
    return episodes.normal_days(price_panel(spark, d).select("ent", "t"), found, ENT, T)
