"""The chain from features to verdict: causality, missing engines, uncalibrated pooling, pooled folds and the Platt map."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chain, engines, pool
from tidemark.operators.features import build_features
from tidemark.plans.panels import raw_panel
from tidemark.sources.staging import stage

ENT, T, SF = ["ent"], "t", "/root/testdata/sf0.01"
SETUP = chain.Setup(x_pct=70.0, h=21, neighbours=20, normal_x=80.0, hmm_rounds=5)
UNTIL, END = "1999-12-31", dt.date(2000, 12, 31)


@pytest.fixture(scope="module")
def panel(spark):
    raw = stage(raw_panel(spark, SF), "raw")
    return stage(build_features(raw, ENT, T), "features"), raw


@pytest.fixture(scope="module")
def model(panel):
    return chain.fit_until(*panel, UNTIL, SETUP, ENT, T)


@pytest.fixture(scope="module")
def scored(panel, model):
    return chain.score(model, *panel, ENT, T)


def by_key(df, *names):
    return {(r["ent"], r["t"]): tuple(r[n] for n in names) for r in df.select("ent", "t", *names).collect()}


def test_all_engines_fit_and_rows_are_scored(scored):
    assert scored.errors == {} and abs(sum(scored.weights.values()) - 1) < 1e-9
    r = scored.rows.agg(F.min("posterior"), F.max("posterior"), F.count("posterior"), F.count("confidence")).first()
    assert 0 < r[0] < r[1] < 1 and r[2] == r[3] > 1000
    bad = scored.rows.filter((F.col("reason") == "OK") != F.col("fires"))
    assert bad.isEmpty()


def test_later_rows_do_not_change_a_score(panel, model, scored):
    names = ["posterior", "base_rate_live", "confidence", "layer1", "layer2"]
    short = by_key(chain.score(model, *panel, ENT, T, "2000-01-01", END.isoformat()).rows, *names)
    long = by_key(scored.rows.filter(F.col("t").between("2000-01-01", END.isoformat())), *names)
    assert short.keys() == long.keys() and len(short) > 500
    for k, v in short.items():
        assert np.allclose(np.array(v, float), np.array(long[k], float), atol=1e-6, equal_nan=True), k


def test_rows_after_the_cutoff_do_not_change_the_fit(panel, model):
    cut = [df.filter(F.col("t") <= UNTIL) for df in panel]
    other = chain.fit_until(*cut, UNTIL, SETUP, ENT, T)
    np.testing.assert_allclose(other.engines["regime"].means, model.engines["regime"].means, atol=1e-6)
    np.testing.assert_allclose(other.engines["anomaly"].cov, model.engines["anomaly"].cov, atol=1e-6)
    assert other.engines["causal"] == model.engines["causal"] and other.engines["analog"].pool.count() == model.engines["analog"].pool.count()


def test_pool_holds_only_outcomes_known_at_the_cutoff(model, panel):
    last = panel[0].filter(F.col("t") <= UNTIL).groupBy("ent").agg(F.sort_array(F.collect_list("t"), False)[max(engines.HORIZONS)].alias("d")).agg(F.max("d")).first()[0]
    assert model.engines["analog"].pool.agg(F.max("t")).first()[0] <= last


def test_an_engine_without_data_is_recorded_and_left_out(panel, model):
    errors = {}
    some = {"anomaly": lambda: chain._fit_anomaly(panel[0], replace(SETUP, min_normal=10**9), ENT, T), "causal": lambda: 1}
    assert chain._attempt(some, errors) == {"causal": 1} and "too few" in errors["anomaly"]
    rest = {e: m for e, m in model.engines.items() if e != "anomaly"}
    out = chain.score(chain.Fitted(UNTIL, SETUP, rest, errors), *panel, ENT, T, "2001-01-01")
    assert set(out.errors) == {"anomaly"} and out.skill["anomaly"] == 0.0
    r = out.rows.agg(F.count("posterior"), F.count("calibrated_anomaly"), F.count(F.lit(1))).first()
    assert r[0] == r[2] > 0 and r[1] == 0


def test_no_engine_at_all_is_an_error(panel):
    with pytest.raises(ValueError, match="no engine"):
        chain.fit_until(*panel, "1990-01-01", SETUP, ENT, T)


def test_filtered_regime_differs_from_smoothed_and_horizon_matters(panel, model):
    features, m = panel[0].filter("ent = 'A'"), model.engines["regime"]
    post = engines.hmm_filter(features, m, ENT, T)
    cut = by_key(engines.hmm_filter(features.filter("t <= '1998-01-01'"), m, ENT, T), "p_0", "p_1")
    full = by_key(post, "p_0", "p_1")
    assert all(np.allclose(v, full[k], atol=1e-9) for k, v in cut.items())  # no smoothing over later rows
    near, far = (by_key(engines.hmm_horizon(post, m, h), "h_step_stress_prob") for h in (1, 126))
    assert max(abs(near[k][0] - far[k][0]) for k in near) > 1e-3


def test_many_thresholds_come_from_one_fit(panel, model):
    queries = stage(model.engines["analog"].whiten(panel[0].filter("t >= '2001-06-01'"), ENT, T), "queries")
    a = model.engines["analog"]
    low, high = (engines.analog_knn(queries, a.pool, "dd_21", x, 21, 20, "_id", T, a.radii) for x in (40.0, 80.0))
    both = low.select("_id", F.col("prob").alias("low")).join(high.select("_id", F.col("prob").alias("high"), "confidence"), "_id")
    r = both.agg(F.count_if(F.col("low") < F.col("high")), F.avg(F.col("low") - F.col("high")), F.min("confidence"), F.max("confidence")).first()
    assert r[0] == 0 and r[1] > 0 and 0 <= r[2] < r[3] <= 1


def test_folds_without_data_are_skipped(panel):
    rows, models, skipped = chain.walk_forward(*panel, ["1990-01-01", "2001-01-01"], SETUP, ENT, T)
    assert set(skipped) == {1} and set(models) == {2} and rows.agg(F.min("t"), F.min("fold"), F.max("fold")).first()[0:] == (dt.date(2001, 1, 1), 2, 2)


def test_report_has_a_verdict_per_fold_and_entity(scored):
    rows = scored.rows.filter("t >= '2000-01-01'").withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    out = chain.report(rows, {0: scored.weights, 1: scored.weights}, SETUP, ENT, T).collect()
    assert len(out) == 2 * rows.select("ent").distinct().count() and all(r["passed"] == (r["failed"] == "") for r in out)
    want = rows.filter("fold = 1 AND ent = 'A' AND y IS NOT NULL").agg(F.avg(F.pow(F.col("posterior") - F.col("y"), 2))).first()[0]
    assert next(r for r in out if (r["fold"], r["ent"]) == (1, "A"))["brier"] == pytest.approx(want)


@pytest.mark.parametrize("scale", [0.5, 2.0])
def test_platt_equals_a_plain_newton_fit(spark, scale):
    g = np.random.default_rng(3)
    x = g.normal(0, 1, 900)
    y = (g.random(900) < 1 / (1 + np.exp(-(scale * x - 0.5)))).astype(float)
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(1 / (1 + np.exp(-a))), b) for i, (a, b) in enumerate(zip(x, y.tolist()))]
    m = pool.platt_calibrate(spark.createDataFrame(rows, "ent string, t date, p double, y double"), "p", "y", ENT, T)

    def plain(u, v):
        w = np.zeros(2)
        for _ in range(100):
            q = 1 / (1 + np.exp(-(w[0] * u + w[1])))
            h = np.array([[(q * (1 - q) * u * u).sum() + 1, (q * (1 - q) * u).sum()], [(q * (1 - q) * u).sum(), (q * (1 - q)).sum()]])
            w = w - np.linalg.solve(h, [((q - v) * u).sum() + w[0], (q - v).sum()])
        return w

    assert np.allclose((m.slope, m.intercept), plain(x, y), atol=1e-5)
    assert m.prior == pytest.approx(y.mean()) and 0.15 <= m.temper <= 1.0


def test_platt_passes_few_rows_and_one_class_through(spark):
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), 0.3, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "ent string, t date, p double, y double")
    assert pool.platt_calibrate(df, "p", "y", ENT, T).slope is None
    assert pool.platt_calibrate(df.limit(50), "p", "y", ENT, T).slope is None
