"""Queries of validation, alerts, serving and streaming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import alerts, chain, validation as va
from tidemark.operators.engines import Hmm, Scaler
from tidemark.operators.features import build_features
from tidemark.plans import q_features
from tidemark.plans.panels import ENT, FIRE, H, PX, SCORED, T, price_panel, raw_panel, rounded, scored_panel
from tidemark.sources.staging import stage
from tidemark.streaming import jobs

QUERIES, SQL = {}, {}
W = "(PARTITION BY ent ORDER BY t)"
CUTOFFS = ["1994-01-01", "1996-01-01", "1997-06-01"]
FOLDS = "fo AS (SELECT px.*, fold FROM px, (VALUES (1, DATE '1994-01-01', DATE '1996-01-01'), (2, DATE '1996-01-01', DATE '1997-06-01'), (3, DATE '1997-06-01', NULL)) AS f(fold, a, b) WHERE t >= a AND (b IS NULL OR t <= b))"
SC = SCORED + f", sf AS (SELECT *, p >= {FIRE} AS f FROM scored)"


def fires():
    return F.col("p") >= FIRE


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("walk_forward_folds", f"WITH {PX}, {FOLDS} SELECT ent, t, fold, px FROM fo")
def _(spark, d):
    return va.walk_forward_folds(price_panel(spark, d), CUTOFFS, T).select("ent", "t", "fold", "px")


@query("pool_folds", f"WITH {PX}, {FOLDS} SELECT ent, t, min(fold) AS fold, any_value(px) AS px FROM fo GROUP BY ent, t")
def _(spark, d):
    return va.pool_folds(va.walk_forward_folds(price_panel(spark, d), CUTOFFS, T), ENT, T).select("ent", "t", "fold", "px")


@query("blind_split", f"WITH {PX} SELECT ent, t, CASE WHEN t < DATE '1997-01-01' THEN 'fit' ELSE 'score' END AS part FROM px")
def _(spark, d):
    return va.blind_split(price_panel(spark, d), "1997-01-01", T).select("ent", "t", "part")


@query("holdout_window", f"WITH {PX}, c AS (SELECT ent, count(*) FILTER (t > DATE '2001-08-01') AS n_rows FROM px GROUP BY ent) SELECT ent, n_rows, n_rows >= 126 AS ready, greatest(0, 126 - n_rows) AS remaining FROM c")
def _(spark, d):
    return va.holdout_window(price_panel(spark, d), "2001-08-01", ENT, T)


CONF = """cf AS (SELECT ent, count(*) FILTER (f AND y = 1) AS tp, count(*) FILTER (f AND y = 0) AS fp, count(*) FILTER (NOT f AND y = 1) AS fn, count(*) FILTER (NOT f AND y = 0) AS tn, avg(y) AS base_rate,
  count(*) FILTER (f) AS n_fires, count(*) FILTER (f) * 100.0::DOUBLE / count(*) AS fire_pct FROM sf GROUP BY ent),
  cm AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM cf)"""


@query("confusion", f"""WITH {SC}, {CONF} SELECT ent, tp, fp, fn, tn, n_fires, round(base_rate, 6) AS base_rate, round(fire_pct, 6) AS fire_pct, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1, round(precision / nullif(base_rate, 0), 6) AS lift FROM cm""")
def _(spark, d):
    return rounded(va.confusion(scored_panel(spark, d), fires(), "y", ENT))


LEADS = SC + f""", lp AS (SELECT a.ent, a.t, b.pos - a.pos AS o, b.px AS p, max(b.px) OVER (PARTITION BY a.ent, a.pos ORDER BY b.pos) AS mx FROM sf a JOIN sf b ON a.ent = b.ent AND b.pos BETWEEN a.pos AND a.pos + {H} WHERE a.f),
  ld AS (SELECT ent, t, min(CASE WHEN (1 - p / mx) * 100 >= 50 THEN o END) AS lead FROM lp GROUP BY ent, t HAVING count(*) >= 2)"""


@query("lead_times", f"WITH {LEADS} SELECT ent, count(lead) AS n_leads, round(median(lead)::DOUBLE, 6) AS median_lead, round(avg(lead), 6) AS mean_lead FROM ld GROUP BY ent")
def _(spark, d):
    return rounded(va.lead_times(scored_panel(spark, d), fires(), "px", 50.0, H, ENT, T))


@query("by_archetype", f"""WITH {LEADS} SELECT tag, count(*) FILTER (f) AS n_fires, round(avg(CASE WHEN f THEN y END), 6) AS precision, round(median(CASE WHEN f THEN lead END)::DOUBLE, 6) AS median_lead,
  CASE WHEN count(*) FILTER (f) > 0 THEN round(avg(y), 6) END AS base_rate FROM sf LEFT JOIN ld USING (ent, t) GROUP BY tag""")
def _(spark, d):
    return rounded(va.by_archetype(scored_panel(spark, d), fires(), "tag", "y", "px", 50.0, H, ENT, T))


BINS = "bn AS (SELECT ent, greatest(ceil(p * 10), 1)::BIGINT AS bin, avg(p) AS mean_p, avg(y) AS mean_y, count(*) AS n FROM sf WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"


@query("calibration_table", f"WITH {SC}, {BINS} SELECT ent, bin, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, n FROM bn")
def _(spark, d):
    return rounded(va.calibration_table(scored_panel(spark, d), "p", "y", ENT))


SUMMARY = BINS + """, ln AS (SELECT ent, sum(n * n)::DOUBLE AS w, sum(n * n * mean_p) AS wx, sum(n * n * mean_y) AS wy, sum(n * n * mean_p * mean_p) AS wxx, sum(n * n * mean_p * mean_y) AS wxy FROM bn GROUP BY ent),
  sl AS (SELECT *, (w * wxy - wx * wy) / nullif(w * wxx - wx * wx, 0) AS slope FROM ln),
  su AS (SELECT ent, avg(power(p - y, 2)) AS brier, avg(-(y * ln(greatest(1e-9, least(1 - 1e-9, p))) + (1 - y) * ln(1 - greatest(1e-9, least(1 - 1e-9, p))))) AS log_loss, avg(y) AS base_rate FROM sf WHERE y IS NOT NULL GROUP BY ent)"""


@query("calibration_summary", f"""WITH {SC}, {SUMMARY} SELECT ent, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(base_rate, 6) AS base_rate, round(1 - brier / nullif(base_rate * (1 - base_rate), 0), 6) AS brier_skill,
  round(slope, 5) AS slope, round((wy - slope * wx) / w, 5) AS intercept FROM su JOIN sl USING (ent)""")
def _(spark, d):
    return rounded(va.calibration_summary(scored_panel(spark, d), "p", "y", ENT)).withColumns({c: F.round(c, 5) for c in ("slope", "intercept")})


def _backtest_sql() -> str:
    side = lambda r, n: f"""round((exp(sum(ln(1 + {r})) * 252.0::DOUBLE / count(*)) - 1) * 100, 5) AS {n}_cagr, round(stddev_samp({r}) * sqrt(252) * 100, 5) AS {n}_vol,
      round(avg({r}) * sqrt(252) / nullif(stddev_samp({r}), 0), 5) AS {n}_sharpe, round(avg({r}) * sqrt(252) / nullif(stddev_samp(CASE WHEN {r} < 0 THEN {r} END), 0), 5) AS {n}_sortino, round(min(d_{n}) * 100, 5) AS {n}_max_drawdown"""  # noqa: E731
    return f"""b1 AS (SELECT *, coalesce(px / nullif(lag(px) OVER {W}, 0) - 1, 0) AS r, max(f::INT) OVER (PARTITION BY ent ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS ob FROM sf),
  b2 AS (SELECT *, 1 - coalesce(lag(ob) OVER {W}, 0) AS inn FROM b1), b3 AS (SELECT *, coalesce((inn <> lag(inn) OVER {W})::INT, 0) AS sw FROM b2), b4 AS (SELECT *, inn * r - sw * 5.0::DOUBLE / 1e4 AS s FROM b3),
  b5 AS (SELECT *, exp(sum(ln(1 + s)) OVER u) AS e_strategy, exp(sum(ln(1 + r)) OVER u) AS e_hold FROM b4 WINDOW u AS (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING)),
  b6 AS (SELECT *, e_strategy / max(e_strategy) OVER u - 1 AS d_strategy, e_hold / max(e_hold) OVER u - 1 AS d_hold FROM b5 WINDOW u AS (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING)),
  bt AS (SELECT ent, {side('s', 'strategy')}, {side('r', 'hold')}, sum(sw)::BIGINT AS n_switches, round(avg(inn) * 100, 5) AS time_in_market_pct,
    round(((exp(sum(ln(1 + s)) * 252.0::DOUBLE / count(*)) - 1) - (exp(sum(ln(1 + r)) * 252.0::DOUBLE / count(*)) - 1)) * 100, 5) AS cagr_delta, round(min(d_strategy) / nullif(min(d_hold), 0), 5) AS drawdown_ratio FROM b6 GROUP BY ent)"""


@query("backtest", f"WITH {SC}, {_backtest_sql()} SELECT * FROM bt")
def _(spark, d):
    return rounded(va.backtest(scored_panel(spark, d), fires(), "px", ENT, T), 5)


@query("kill_check", f"""WITH {SC}, {SUMMARY}, {CONF}, {_backtest_sql()}, k AS (SELECT ent, slope, cagr_delta, drawdown_ratio, fire_pct, 0.4::DOUBLE AS max_weight FROM sl JOIN bt USING (ent) JOIN cf USING (ent)),
  f AS (SELECT *, concat_ws(',', CASE WHEN NOT coalesce(slope BETWEEN 0.5 AND 1.5, false) THEN 'calibration' END, CASE WHEN NOT coalesce(cagr_delta >= -2, false) THEN 'cagr' END,
    CASE WHEN NOT coalesce(drawdown_ratio <= 1.1, false) THEN 'drawdown' END, CASE WHEN NOT coalesce(fire_pct BETWEEN 0.1 AND 10, false) THEN 'fires' END) AS failed FROM k) SELECT ent, failed, failed = '' AS passed FROM f""")
def _(spark, d):
    df = scored_panel(spark, d)
    m = va.calibration_summary(df, "p", "y", ENT).select("ent", "slope").join(va.backtest(df, fires(), "px", ENT, T).select("ent", "cagr_delta", "drawdown_ratio"), "ent")
    m = m.join(va.confusion(df, fires(), "y", ENT).select("ent", "fire_pct"), "ent").withColumn("max_weight", F.lit(0.4))
    return va.kill_check(m).select("ent", "failed", "passed")


@query("purged_splits", f"""WITH {PX}, n AS (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM px GROUP BY ent))
  SELECT f AS fold, f * 21 + 1260 AS train_end, f * 21 + 1281 AS test_start, f * 21 + 1533 AS test_end FROM (SELECT unnest(range(greatest(0, (n - 1533) // 21 + 1))) AS f FROM n)""")
def _(spark, d):
    n = price_panel(spark, d).groupBy("ent").count().agg(F.max("count")).first()[0]
    return va.purged_splits(spark, n)


def _mean_model(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"ent": test["ent"], "fold": test["fold"], "t": test["t"], "forecast": train["px"].mean()})


@query("walk_forward_run", f"""WITH {PX}, q AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM px), n AS (SELECT max(pos) + 1 AS n FROM q), s AS (SELECT unnest(range(greatest(0, (n - 1533) // 21 + 1))) * 21 + 1260 AS e FROM n), m AS (SELECT ent, e, avg(px) AS forecast FROM q JOIN s ON pos < e GROUP BY ALL)
  SELECT q.ent, (e - 1260) // 21 AS fold, t, round(forecast, 6) AS forecast FROM q JOIN m ON q.ent = m.ent AND pos BETWEEN e + 21 AND e + 272""")
def _(spark, d):
    df = price_panel(spark, d)
    splits = va.purged_splits(spark, df.groupBy("ent").count().agg(F.max("count")).first()[0])
    return rounded(va.walk_forward_run(df.select("ent", "t", "px"), splits, _mean_model, "ent string, fold long, t date, forecast double", ENT, T))


# --- the whole chain: features, four engines, pooling, gate, verdict ---

#: The panel's prices fall by 10 % nearly every day, so its label and normal days take larger falls.
CHAIN = chain.Setup(x_pct=70.0, h=63, normal_x=80.0)
CHAIN_CUTOFFS = ["1998-01-01", "1999-07-01", "2000-10-01"]


def _indicators(spark, d):
    raw = stage(raw_panel(spark, d), "raw")
    return stage(build_features(raw, ENT, T), "features"), raw


@query("fit_and_score")
def _(spark, d):
    out = chain.fit_and_score(*_indicators(spark, d), "1999-12-31", CHAIN, ENT, T, "2000-01-01")
    return rounded(out.rows.select("ent", "t", "posterior", "base_rate_live", "confidence", *chain.LAYERS, "fires", "reason", *[f"contribution_{e}" for e in chain.ENGINES]), 4)


@query("walk_forward_validation")
def _(spark, d):
    return rounded(chain.validate(*_indicators(spark, d), CHAIN_CUTOFFS, CHAIN, ENT, T), 4)


@query("blind_validation")
def _(spark, d):
    return rounded(chain.blind(*_indicators(spark, d), "2000-01-01", CHAIN, ENT, T)[0], 4)


@query("smote_oversample")
def _(spark, d):
    return rounded(va.smote_oversample(scored_panel(spark, d).filter("y IS NOT NULL"), ["disc", "tax"], "y", ENT))


FM = SC + f""", fo AS (SELECT sf.*, fold FROM sf, (VALUES (1, DATE '1994-01-01', DATE '1996-01-01'), (2, DATE '1996-01-01', DATE '1997-06-01'), (3, DATE '1997-06-01', NULL)) AS f(fold, a, b) WHERE t >= a AND (b IS NULL OR t <= b) AND y IS NOT NULL),
  cu AS (SELECT fold, p, sum(y) AS a, sum(1 - y) AS b FROM fo GROUP BY ALL), cv AS (SELECT *, sum(a) OVER u AS tp, sum(b) OVER u AS fp FROM cu WINDOW u AS (PARTITION BY fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
  ar AS (SELECT fold, sum(b * (2 * tp - a) / 2) / nullif(max(tp) * max(fp), 0) AS auc, sum(a * (tp / (tp + fp) + CASE WHEN tp - a + fp - b > 0 THEN (tp - a) / (tp - a + fp - b) ELSE 1 END) / 2) / nullif(max(tp), 0) AS pr_auc FROM cv GROUP BY fold),
  c AS (SELECT fold, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn, avg(power(p - y, 2)) AS brier FROM fo GROUP BY fold),
  m AS (SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM c),
  fm AS (SELECT fold, accuracy, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, auc FROM m JOIN ar USING (fold))"""


def _folded(spark, d):
    return va.walk_forward_folds(scored_panel(spark, d), CUTOFFS, T).filter("y IS NOT NULL")


@query("fold_metrics", f"WITH {FM} SELECT fold, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "auc")) + " FROM fm")
def _(spark, d):
    return rounded(va.fold_metrics(_folded(spark, d), "p", "y", ["fold"]))


@query("aggregate_folds", f"WITH {FM} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(coalesce(avg({c}), 0), 6) AS mean, round(coalesce(stddev_pop({c}), 0), 6) AS std FROM fm" for c in ("accuracy", "precision", "recall", "f1", "auc")))
def _(spark, d):
    return rounded(va.aggregate_folds(va.fold_metrics(_folded(spark, d), "p", "y", ["fold"]), ["accuracy", "precision", "recall", "f1", "auc"]))


@query("classification_report", f"""WITH {FM}, e AS (SELECT fold, avg(abs(mp - my)) AS ce FROM (SELECT fold, greatest(ceil(p * 10), 1) AS bin, avg(p) AS mp, avg(y) AS my FROM fo GROUP BY ALL) GROUP BY fold)
  SELECT fold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity,
  round(fp::DOUBLE / nullif(tn + fp, 0), 6) AS fpr, round(fn::DOUBLE / nullif(tp + fn, 0), 6) AS fnr, round(auc, 6) AS auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier, round(ce, 6) AS calibration_error FROM m JOIN ar USING (fold) JOIN e USING (fold)""")
def _(spark, d):
    return rounded(va.classification_report(_folded(spark, d), "p", "y", ["fold"]))


@query("event_lead_backtest", f"""WITH {SC}, w AS (SELECT *, last_value(CASE WHEN p > 0.6 THEN t END IGNORE NULLS) OVER (PARTITION BY ent ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wn FROM sf),
  l AS (SELECT *, tax > 5 AS cr, CASE WHEN tax > 5 AND t - wn <= 60 THEN t - wn END AS ld FROM w) SELECT ent, count(*) FILTER (cr) AS n_crashes, count(ld) AS n_detected, round(avg(ld), 6) AS avg_lead, min(ld) AS min_lead, max(ld) AS max_lead,
  round(count(ld)::DOUBLE / nullif(count(*) FILTER (cr), 0), 6) AS detection_rate, round(count(*) FILTER (p > 0.6 AND NOT cr)::DOUBLE / nullif(count(*) FILTER (p > 0.6), 0), 6) AS false_alarm_rate FROM l GROUP BY ent""")
def _(spark, d):
    return rounded(va.event_lead_backtest(scored_panel(spark, d), "p", F.col("tax") > 5, ENT, T, threshold=0.6))


def _runs(spark, d):
    orders, customers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("c_mktsegment").alias("model"), F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("start_time"), F.col("o_totalprice").alias("metric"), F.col("o_orderpriority").alias("kind")
    )


RUNS = "runs AS (SELECT c_mktsegment AS model, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS start_time, o_totalprice AS metric, o_orderpriority AS kind FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("model_comparison", f"""WITH {RUNS} SELECT model, coalesce(max(metric) FILTER (kind = '1-URGENT'), 0) AS "1-URGENT", coalesce(max(metric) FILTER (kind = '5-LOW'), 0) AS "5-LOW", 0.0::DOUBLE AS none FROM runs GROUP BY model""")
def _(spark, d):
    best = _runs(spark, d).groupBy("model", "kind").agg(F.max("metric").alias("v"))
    return va.model_comparison(best, "model", "kind", "v", ["1-URGENT", "5-LOW", "none"])


@query("best_run", f"WITH {RUNS} SELECT model, run_id, start_time, metric FROM runs WHERE model = 'BUILDING' ORDER BY metric DESC, run_id LIMIT 1")
def _(spark, d):
    return va.best_run(_runs(spark, d), "metric", "BUILDING").select("model", "run_id", "start_time", "metric")


@query("latest_runs", f"WITH {RUNS} SELECT model, start_time, run_id, metric FROM runs WHERE model IN ('BUILDING', 'MACHINERY') QUALIFY row_number() OVER (PARTITION BY model ORDER BY start_time DESC, run_id DESC) = 1")
def _(spark, d):
    return va.latest_runs(_runs(spark, d), ["BUILDING", "MACHINERY"], ["metric"])


@query("run_history", f"WITH {RUNS} SELECT model, run_id, start_time, metric FROM runs WHERE model = 'HOUSEHOLD' ORDER BY start_time DESC, run_id DESC LIMIT 10")
def _(spark, d):
    return va.run_history(_runs(spark, d), "HOUSEHOLD").select("model", "run_id", "start_time", "metric")


# --- alerts and serving: events are predictions with p = value / 500 ---

EV = "ev AS (SELECT user_id AS ent, ts AS t, event_id, event_type, least(value / 500, 1) AS p FROM events)"
DAILY = "dy AS (SELECT user_id AS ent, CAST(ts AS DATE) AS t, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / count(*) / 500 AS p FROM events GROUP BY ALL)"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("ent"), F.col("ts").alias("t"), "event_id", "event_type", F.least(F.col("value") / 500, F.lit(1.0)).alias("p"))


def _daily(spark, d):
    mean = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 500
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("ent"), F.to_date("ts").alias("t")).agg(mean.alias("p"))


def _alarm_sql(limits) -> str:
    rate = lambda k: f"CASE WHEN lag(p, {k}) OVER {W} = 0 THEN 0 ELSE (p - lag(p, {k}) OVER {W}) / lag(p, {k}) OVER {W} / {k} END"
    return f"CASE WHEN row_number() OVER {W} <= 2 THEN 'none' " + " ".join(f"WHEN {rate(k)} > {x} THEN '{s}'" for k, x, s in limits) + " ELSE 'none' END"


@query("roc_alarm", f"WITH {EV} SELECT ent, t, {_alarm_sql(alerts.ML_ALARM)} AS alarm FROM ev")
def _(spark, d):
    return alerts.roc_alarm(_events(spark, d), "p", ENT, T).select("ent", "t", "alarm")


@query("combined_alarm", f"""WITH {EV}, a AS (SELECT ent, t, {_alarm_sql(alerts.ML_ALARM)} AS ml, {_alarm_sql(alerts.STAT_ALARM)} AS stat FROM ev)
  SELECT ent, t, CASE (ml <> 'none')::INT + (stat <> 'none')::INT WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'none' END AS combined FROM a""")
def _(spark, d):
    both = alerts.roc_alarm(alerts.roc_alarm(_events(spark, d), "p", ENT, T, out="ml"), "p", ENT, T, alerts.STAT_ALARM, "stat")
    return alerts.combined_alarm(both, "ml", "stat").select("ent", "t", "combined")


@query("slope_alert", f"""WITH {DAILY}, s AS (SELECT ent, t, (p - first_value(p) OVER w) / nullif(t - first_value(t) OVER w, 0) AS slope FROM dy WINDOW w AS (PARTITION BY ent ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT ent, t, round(slope, 9) AS slope, CASE WHEN abs(slope) >= 0.1 THEN 2 WHEN abs(slope) >= 0.05 THEN 1 WHEN slope IS NOT NULL THEN 0 END AS level, coalesce(abs(slope) >= 0.1, false) AS alert FROM s""")
def _(spark, d):
    return rounded(alerts.slope_alert(_daily(spark, d), "p", ENT, T).select("ent", "t", "slope", "level", "alert"), 9)


@query("risk_level", f"WITH {EV} SELECT event_id, CASE WHEN p >= 0.8 THEN 'CRITICAL' WHEN p >= 0.6 THEN 'HIGH' WHEN p >= 0.4 THEN 'MODERATE' WHEN p >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS risk FROM ev")
def _(spark, d):
    return _events(spark, d).select("event_id", alerts.risk_level("p").alias("risk"))


@query("threshold_alert", f"WITH {EV} SELECT event_id, p, 'critical' AS severity FROM ev WHERE p >= 0.5")
def _(spark, d):
    return alerts.threshold_alert(_events(spark, d), "p", 0.5).select("event_id", "p", "severity")


@query("latest_prediction", f"WITH {EV} SELECT event_id, t, p FROM ev ORDER BY t DESC, event_id DESC LIMIT 1")
def _(spark, d):
    return alerts.latest_prediction(_events(spark, d), "t", "event_id").select("event_id", "t", "p")


@query("prediction_history", f"""WITH {EV}, h AS (SELECT event_id, t, p FROM ev WHERE t >= TIMESTAMP '2024-01-05' AND t <= TIMESTAMP '2024-01-20' ORDER BY t DESC, event_id DESC LIMIT 200)
  SELECT *, count(*) OVER () AS n, min(t) OVER () AS first_date, max(t) OVER () AS last_date FROM h""")
def _(spark, d):
    rows = _events(spark, d).select("event_id", "t", "p")
    return alerts.prediction_history(rows, "t", "event_id", pd.Timestamp("2024-01-05").to_pydatetime(), pd.Timestamp("2024-01-20").to_pydatetime(), 200)


@query("alert_log_tail", f"WITH {EV} SELECT event_id, t FROM ev WHERE event_type = 'error' ORDER BY t DESC, event_id DESC LIMIT 100")
def _(spark, d):
    return alerts.alert_log_tail(_events(spark, d).filter("event_type = 'error'").select("event_id", "t"), "t", "event_id")


@query("fire_breakdown", f"""WITH {SC}, r AS (SELECT *, 'qty ' || floor(qty / 50)::INT AS why FROM sf), w AS (SELECT 'reason' AS kind, why AS name, count(*) AS n FROM r WHERE NOT f GROUP BY why ORDER BY n DESC, name LIMIT 10)
  SELECT 'archetype' AS kind, tag AS name, count(*) AS n FROM r WHERE f GROUP BY tag UNION ALL SELECT * FROM w""")
def _(spark, d):
    df = scored_panel(spark, d).withColumn("why", F.concat(F.lit("qty "), F.floor(F.col("qty") / 50).cast("int")))
    return alerts.fire_breakdown(df, fires(), "tag", "why")


@query("days_to_bottom", """SELECT o_orderkey, (o_orderkey % 50)::INT AS days_to_bottom, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 90)::INT END AS days_to_recovery FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC LIMIT 30""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("made"))
    o = o.withColumns({"bottom": F.expr("date_add(made, int(o_orderkey % 50))"), "recovery": F.when(F.col("o_orderkey") % 3 != 0, F.expr("date_add(made, int(o_orderkey % 90))"))})
    return alerts.days_to_bottom(o, "made", "bottom", "recovery", "o_orderkey").select("o_orderkey", "days_to_bottom", "days_to_recovery")


@query("coverage_status", f"""WITH {PX}, c AS (SELECT 'px' AS "column", count(px) AS n FROM px UNION ALL SELECT 'few', count(CASE WHEN day(t) < 5 THEN px END) FROM px UNION ALL SELECT 'none', 0)
  SELECT "column", n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM px), 6) AS pct, CASE WHEN n * 2 >= (SELECT count(*) FROM px) THEN 'ok' WHEN n > 0 THEN 'sparse' ELSE 'empty' END AS status FROM c""")
def _(spark, d):
    from tidemark.operators.pit import coverage_report

    df = price_panel(spark, d).withColumns({"few": F.when(F.dayofmonth("t") < 5, F.col("px")), "none": F.lit(None).cast("double")})
    cov = coverage_report(df, ["px", "few", "none"]).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    return rounded(alerts.coverage_status(cov, F.col("_all")).select("column", "n", "pct", "status"))


# --- streaming: run to the end over the events table ---


def _stream(spark, d):
    return jobs.read_stream(spark, f"{d}/events.parquet")


@query("stream_upsert", """WITH f AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) SELECT user_id, event_type, ts, value FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1""")
def _(spark, d):
    return jobs.stream_upsert(_stream(spark, d).select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"], "ts")


@query("stream_daily_mean", "SELECT event_type, CAST(ts AS DATE) AS d, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def _(spark, d):
    return rounded(jobs.stream_daily_mean(_stream(spark, d), ["event_type"], "ts", "value"))


@query("stream_roc_alarm", f"WITH {EV} SELECT ent, t, {_alarm_sql(alerts.ML_ALARM)} AS alarm FROM ev")
def _(spark, d):
    s = _stream(spark, d).select(F.col("user_id").alias("ent"), F.col("ts").alias("t"), F.least(F.col("value") / 500, F.lit(1.0)).alias("p"))
    return jobs.stream_roc_alarm(s, "p", ENT, T).select("ent", "t", "alarm")


@query("stream_base_rate", f"""WITH e AS (SELECT user_id AS ent, ts AS t, (value > 50)::INT::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events),
  r AS (SELECT *, CASE WHEN pos % 5 = 0 AND count(y) OVER w >= 8 THEN avg(y) OVER w END AS v FROM e WINDOW w AS (PARTITION BY ent ORDER BY t ROWS BETWEEN 27 PRECEDING AND 8 PRECEDING))
  SELECT ent, t, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING), 0.5), 6) AS base_rate_live FROM r""")
def _(spark, d):
    s = _stream(spark, d).select(F.col("user_id").alias("ent"), F.col("ts").alias("t"), (F.col("value") > 50).cast("double").alias("y"))
    return rounded(jobs.stream_base_rate(s, "y", 7, 0.5, ENT, T, window=20, every=5, min_rows=8))


def _toy_hmm() -> Hmm:
    return Hmm(Scaler(("x",), (0.0,), (0.0,), (1.0,)), np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.05], [0.3]]), np.array([[[0.01]], [[0.04]]]))


@query("stream_hmm_filter")
def _(spark, d):
    s = _stream(spark, d).select(F.col("user_id").alias("ent"), F.col("ts").alias("t"), (F.col("value") / 500).alias("z_x"))
    return rounded(jobs.stream_hmm_filter(s, _toy_hmm(), ["z_x"], ENT, T))


@query("crash_history", q_features.SQL["dedupe_crashes"])
def _(spark, d):
    return alerts.crash_history(q_features.QUERIES["dedupe_crashes"](spark, d))
