"""Hand-worked cases, null policy, causality and the helpers' properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import panel, values
from tidemark.functions import vec, windows as wf
from tidemark.functions.rolling import Rolled, rolled
from tidemark.operators import alerts, clean, engines, episodes, labels, pool, validation
from tidemark.sources import tables

ENT, T = ["ent"], "t"
rng = np.random.default_rng(7)
WALK = (100 * np.exp(np.cumsum(rng.normal(0.0004, 0.02, 700)))).tolist()


def test_forward_maxdd_by_hand(spark):
    df = labels.forward_maxdd(panel(spark, [100, 105, 110, 88, 95, 100, 100, 100]), "px", 3, ENT, T)
    got = values(df, "fwd_maxdd")
    assert got[0] == pytest.approx(20.0)
    assert got[-3:] == [None] * 3


@pytest.mark.parametrize("h", [1, 5, 21, 63])
def test_forward_maxdd_equals_loop(spark, h):
    p = WALK[:200]
    want = [max(1 - p[u] / max(p[i : u + 1]) for u in range(i, i + h + 1)) * 100 if i + h < len(p) else None for i in range(len(p))]
    got = values(labels.forward_maxdd(panel(spark, p), "px", h, ENT, T), "fwd_maxdd")
    assert [None if x is None else round(x, 8) for x in got] == [None if x is None else round(x, 8) for x in want]


def test_missing_price_makes_the_label_unknown(spark):
    got = values(labels.forward_maxdd(panel(spark, [10, 9, None, 8, 7, 6]), "px", 2, ENT, T), "fwd_maxdd")
    assert got[:3] == [None] * 3 and got[3] is not None


@pytest.mark.parametrize("make", [
    lambda df: wf.expanding_z("px", ENT, T, 30), lambda df: wf.rolling(F.stddev_samp, "px", 21, ENT, T), lambda df: wf.drawdown_from_ath("px", ENT, T),
])
def test_windows_are_stable_on_prefixes(spark, make):
    long, short = panel(spark, WALK[:150]), panel(spark, WALK[:100])
    a, b = values(long.withColumn("v", make(long)), "v")[:100], values(short.withColumn("v", make(short)), "v")
    assert [None if x is None else round(x, 9) for x in a] == [None if x is None else round(x, 9) for x in b]


def test_windows_equal_pandas(spark):
    s, df = pd.Series(WALK[:150]), panel(spark, WALK[:150])
    got = rolled(df, {"s": Rolled("skew", "px", 21), "k": Rolled("kurt", "px", 21)}, ENT, T).orderBy("t").toPandas()
    np.testing.assert_allclose(got["s"].astype(float), s.rolling(21).skew(), atol=1e-6)
    np.testing.assert_allclose(got["k"].astype(float), s.rolling(21).kurt(), atol=1e-5)
    acf = values(rolled(df, {"a": Rolled("acf", "px", 63, lag=10)}, ENT, T), "a")
    assert acf[80] == pytest.approx(pd.Series(WALK[18:81]).autocorr(10))


def test_episode_closes_at_the_peak_price(spark):
    p = [100.0] * 260 + list(np.linspace(100, 60, 20)) + list(np.linspace(62, 101, 20)) + [101.0] * 5
    row = episodes.drawdown_episodes(panel(spark, p), "px", 20.0, ENT, T).collect()
    assert len(row) == 1 and row[0]["trough_price"] == 60.0 and row[0]["peak_price"] == 100.0 and row[0]["recovery_date"] is not None
    assert row[0]["severity_tier"] == "extreme"


def test_open_episode_is_kept_and_short_series_has_none(spark):
    p = [100.0] * 260 + list(np.linspace(100, 60, 20))
    assert episodes.drawdown_episodes(panel(spark, p), "px", 20.0, ENT, T).first()["recovery_date"] is None
    assert episodes.drawdown_episodes(panel(spark, p[:50]), "px", 20.0, ENT, T).count() == 0


def test_fill_and_interpolate(spark):
    got = clean.fill_missing(panel(spark, [None, 20, None, 21, None, 22]), [], ["px"], ENT, T)
    assert values(got, "px") == [20, 20, 20.5, 21, 21.5, 22]
    assert values(clean.fill_missing(panel(spark, [1, None, 1.5, None]), ["px"], [], ENT, T), "px") == [1, 1, 1.5, 1.5]


def test_screen_verdicts(spark):
    flat = [17.24] * 1200 + rng.normal(20, 5, 800).tolist()
    assert clean.screen_columns(panel(spark, flat), ["px"], ENT, T).first()["verdict"] == "constant_fill"
    noise = rng.normal(1.0, 0.033, 2000).tolist()
    assert clean.screen_columns(panel(spark, noise), ["px"], ENT, T).first()["verdict"] == "implausible_noise"
    assert clean.screen_columns(panel(spark, WALK), ["px"], ENT, T).first()["verdict"] == "ok"


def test_upsert_supplied_null_wins(spark):
    target = spark.createDataFrame([(1, 1.5, "x"), (2, 2.5, "y")], "k int, a double, b string")
    up = spark.createDataFrame([(1, None), (3, 9.0)], "k int, a double")
    assert sorted(map(tuple, tables.upsert_rows(target, up, ["k"]).collect())) == [(1, None, "x"), (2, 2.5, "y"), (3, 9.0, None)]


@pytest.mark.parametrize("skill", [{"a": 0, "b": 0, "c": 0.99, "d": 0}, {"a": 0, "b": 0, "c": 0, "d": 0}, {"a": 0.4, "b": 0.1, "c": 0.2, "d": 0.05}])
def test_weights_are_bounded(skill):
    w = pool.bounded_weights(skill)
    assert sum(w.values()) == pytest.approx(1) and all(0.0999 <= x <= 0.4501 for x in w.values())


def test_bins_shrink_and_fall_back(spark):
    sparse = spark.createDataFrame([(i / 200, 0.0) for i in range(200)] + [(1.0, 1.0)] * 3, "p double, y double")
    assert max(pool.fit_bins(sparse, "p", "y").rates) < 1
    one = spark.createDataFrame([(i / 100, 1.0) for i in range(100)], "p double, y double")
    assert one.select(pool.apply_bins(F.col("p"), pool.fit_bins(one, "p", "y")).alias("v")).first()["v"] == 1.0


def test_missing_engine_stays_out_of_the_pool(spark):
    df = spark.createDataFrame([(0.9, None), (None, None)], "calibrated_a double, calibrated_b double")
    got = [r["posterior"] for r in pool.log_odds_pool(df, {"a": 0.5, "b": 0.5}, 0.3).collect()]
    assert got[0] == pytest.approx(0.9) and got[1] is None


def test_live_base_rate_ignores_the_future(spark):
    y = (rng.random(900) < 0.3).astype(float)
    rows = lambda v: panel(spark, v).select("ent", "t", F.col("px").alias("y"), F.lit(0.5).alias("p"))
    changed = np.concatenate([y[:600], 1 - y[600:]])
    a, b = (values(pool.live_base_rate(rows(v), "p", "y", 63, 0.2, ENT, T), "base_rate_live") for v in (y, changed))
    assert a[:663] == b[:663] and a[:250] == [0.2] * 250


def test_gate_reason_lists_failures_in_order(spark):
    df = spark.createDataFrame([(0.9, 0.1, 2.0, 0.0, 3.0, 0.3), (0.9, 0.9, 2.0, 2.0, 3.0, 0.3), (None, 0.9, 2.0, 2.0, 3.0, 0.3)], "posterior double, confidence double, layer1 double, layer2 double, layer3 double, base_rate_live double")
    assert [r["reason"] for r in pool.gate_reason(df).collect()] == ["conf & L2", "OK", "post"]


def test_backtest_without_fires_is_hold(spark):
    r = validation.backtest(panel(spark, WALK), F.lit(False), "px", ENT, T).first()
    assert r["cagr_delta"] == pytest.approx(0) and r["n_switches"] == 0


def test_neighbours_equal_brute_force(spark):
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(120)], "id long, w array<double>")
    got = engines.nearest(df, df, 5, None, "id", None, keep=["id"]).orderBy("id", "rank").collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert [r["pool_id"] for r in got] == np.argsort(d, axis=1)[:, :5].ravel().tolist()


def test_embargo_keeps_near_days_out(spark):
    df = panel(spark, WALK[:100]).withColumn("w", F.array("px"))
    got = engines.nearest(df, df, 3, 10, "t", "t", keep=["t"]).collect()
    assert got and all(abs((r["t"] - r["pool_t"]).days) > 10 for r in got)


def test_hmm_posteriors_sum_to_one_and_use_no_later_row(spark):
    x = np.concatenate([rng.normal(0, 0.5, 150), rng.normal(2, 1.0, 150)])
    df = panel(spark, x.tolist())
    m = engines.hmm_fit(df, ["px"], ENT, T, n_states=2, rounds=5)
    full = engines.hmm_filter(df, m, ENT, T).orderBy("t").toPandas()
    part = engines.hmm_filter(panel(spark, x[:200].tolist()), m, ENT, T).orderBy("t").toPandas()
    np.testing.assert_allclose(full[["p_0", "p_1"]].sum(axis=1), 1)
    np.testing.assert_allclose(full[["p_0", "p_1"]].to_numpy()[:200], part[["p_0", "p_1"]].to_numpy(), atol=1e-8)


def test_ledoit_wolf_equals_direct_form(spark):
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1.0]])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    mean, cov, shrink = engines.ledoit_wolf_cov(df, ["a", "b", "c"])
    z = x - x.mean(0)
    want, s = vec.ledoit_wolf(300, z.T @ z, ((z**2).sum(1) ** 2).sum())
    np.testing.assert_allclose(cov, want, atol=1e-9)
    assert 0 <= shrink <= 1 and shrink == pytest.approx(s)


def test_alarms_and_risk(spark):
    got = values(alerts.roc_alarm(panel(spark, [0.1, 0.1, 0.1, 0.2, 0.0, 0.5]), "px", ENT, T), "alarm")
    assert got[:2] == ["none", "none"] and got[3] == "high" and got[5] == "medium"  # five rows back
    levels = panel(spark, [0.85, 0.6, 0.41, 0.2, 0.1, None]).select("t", alerts.risk_level("px").alias("r"))
    assert values(levels, "r") == ["CRITICAL", "HIGH", "MODERATE", "LOW", "MINIMAL", None]


def test_business_days(spark):
    day = spark.sql("SELECT date'2024-01-05' AS fri, date'2024-01-06' AS sat")
    r = day.select(*[episodes.business_shift(F.col(c), n).alias(f"{c}{n}") for c in ("fri", "sat") for n in (1, -1, 20, -20)]).first()
    bd = lambda d, n: (pd.Timestamp(d) + pd.tseries.offsets.BDay(n)).date()
    assert r["fri1"] == bd("2024-01-05", 1) and r["fri-1"] == bd("2024-01-05", -1) and r["fri20"] == bd("2024-01-05", 20) and r["fri-20"] == bd("2024-01-05", -20)


def test_large_reference_ranks_as_a_small_one(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 11 == 0 else float(i * 7 % 13) / 2) for i in range(60)], "i int, s double")
    ref = spark.createDataFrame([(float(i % 9),) for i in range(50)] + [(None,)], "s double")
    ranks = lambda: {r["i"]: r["rank"] for r in engines.rank_vs_reference(df, "s", ref).collect()}
    small = ranks()
    monkeypatch.setattr(engines, "REFERENCE_ROWS", 10)
    assert ranks() == pytest.approx(small, nan_ok=True) and small[0] is None and len(small) == 60


def test_raw_panel_reads_the_line_items_once(spark):
    from tidemark.plans.panels import price_panel, raw_panel

    raw = raw_panel(spark, "/root/testdata/sf0.001")
    assert raw.inputFiles() and not [f for f in raw.inputFiles() if "lineitem" in f]
    assert raw.count() == price_panel(spark, "/root/testdata/sf0.001").count()
