"""Jobs in time blocks: the same results for any block length, and as plain loops give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import values
from tidemark.functions import blocks
from tidemark.functions.rolling import Rolled, expanding_z_columns, rolled
from tidemark.operators import engines, episodes, features, pool

ENT, T = ["ent"], "t"


@pytest.fixture
def many_ranges(spark):
    """Range exchanges keep their four partitions, so an entity lies in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def frame(spark, columns, ent="a"):
    """{name: values} as a panel of one entity; NaN is null."""
    n = len(next(iter(columns.values())))
    rows = [(ent, d, *(None if np.isnan(v[i]) else float(v[i]) for v in columns.values())) for i, d in enumerate(pd.date_range("2000-01-01", periods=n).date)]
    return spark.createDataFrame(rows, "ent string, t date, " + ", ".join(f"{c} double" for c in columns))


def walk(n, seed, step=0.02):
    return np.round(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, step, n))), 1)  # rounding makes ties


def same(a, b, by=("ent", "t"), **close):
    a, b = (x.toPandas().sort_values(list(by)).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float or b[c].dtype == float:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), **({"atol": 1e-9, "rtol": 1e-7} | close), err_msg=c)
        else:
            assert a[c].equals(b[c]), c


def test_positions_run_on_over_ranges(spark, many_ranges):
    df = frame(spark, {"x": np.arange(200.0)}).union(frame(spark, {"x": np.arange(3.0)}, "b")).union(frame(spark, {"x": np.arange(2.0)}, None)).repartition(7)
    got = blocks.positions(df, ENT, T)
    assert got.filter(F.col("_pos") != F.col("x")).count() == 0 and got.count() == 205
    cut = blocks.halo(got, 50, 20).filter("ent = 'a'").groupBy("_block").agg(F.sum(F.col("_own").cast("int")).alias("own"), F.count(F.lit(1)).alias("n")).orderBy("_block").collect()
    assert [(r["own"], r["n"]) for r in cut][:4] == [(50, 50), (50, 70), (50, 70), (50, 70)]


def plain_episodes(p, x, least, lookback):
    out, at, n = [], 0, len(p)
    if n < lookback:
        return out
    high = [max(p[max(0, i - lookback + 1) : i + 1]) for i in range(n)]
    while at < n:
        if p[at] / high[at] - 1 > -x / 100:
            at += 1
            continue
        peak = max(j for j in range(at + 1) if p[j] >= high[at])
        end = next((j for j in range(at + 1, n) if p[j] >= p[peak]), None)
        stretch = p[at : (n - 1 if end is None else end) + 1]
        low = at + int(np.argmin(stretch))
        if low - peak >= least:
            out.append((peak, low, end))
        at = n if end is None else end + 1
    return out


@pytest.mark.parametrize("rows", [23, 50_000])
def test_episodes_equal_a_plain_loop(spark, many_ranges, rows):
    series = {"a": walk(400, 1), "b": walk(300, 2, 0.05), "c": walk(90, 3), "d": np.linspace(100, 300, 150), "e": np.concatenate([np.full(60, 100.0), np.linspace(99, 40, 80), np.full(60, 41.0), [101.0], walk(50, 4, 0.06)])}
    df = None
    for name, p in series.items():
        one = frame(spark, {"px": p}, name)
        df = one if df is None else df.union(one)
    got = episodes.drawdown_episodes(df.union(frame(spark, {"px": np.array([np.nan])}, "f")), "px", 7.0, ENT, T, 2, 100, rows).collect()
    days = pd.date_range("2000-01-01", periods=400).date
    want = [(name, days[a], days[b], None if c is None else days[c], b - a, None if c is None else c - b, p[a], p[b]) for name, p in series.items() for a, b, c in plain_episodes(p.tolist(), 7.0, 2, 100)]
    have = [(r["ent"], r["peak_date"], r["trough_date"], r["recovery_date"], r["duration_to_trough_td"], r["duration_to_recovery_td"], r["peak_price"], r["trough_price"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str) and len(want) > 5 and any(w[3] is None for w in want)


def test_hmm_is_the_same_for_any_block_length(spark, many_ranges):
    g = np.random.default_rng(5)
    make = lambda n, seed: {"a": np.random.default_rng(seed).normal(0, 1, n) + 3 * (np.arange(n) // 40 % 2), "b": g.normal(0, 1, n)}
    df = frame(spark, make(203, 1)).union(frame(spark, make(30, 2), "b"))
    whole = engines.hmm_fit(df, ["a", "b"], ENT, T, n_states=3, rounds=4, tol=-np.inf)
    parts = engines.hmm_fit(df, ["a", "b"], ENT, T, n_states=3, rounds=4, tol=-np.inf, rows=17)
    for c in ("start", "trans", "means", "covs", "loglik"):
        np.testing.assert_allclose(getattr(parts, c), getattr(whole, c), rtol=1e-9, atol=1e-12)
    same(engines.hmm_filter(df, whole, ENT, T, rows=17), engines.hmm_filter(df, whole, ENT, T))


def test_rolling_equals_pandas_for_any_block_length(spark, many_ranges):
    x, y = walk(260, 6), walk(260, 7)
    x[[30, 31, 90]], y[200] = np.nan, np.nan
    x[120:160] = 50.0  # no variation
    specs = {
        "m": Rolled("mean", "x", 40, 20), "s": Rolled("std", "x", 30), "hi": Rolled("max", "x", 25), "lo": Rolled("min", "x", 25), "sk": Rolled("skew", "x", 30), "ku": Rolled("kurt", "x", 30),
        "co": Rolled("corr", "x", 30, other="y"), "ac": Rolled("acf", "x", 40, lag=5), "d": Rolled("since_max", "x", 35),
    }
    df = frame(spark, {"x": x, "y": y})
    a, b = rolled(df, specs, ENT, T, rows=19), rolled(df, specs, ENT, T)
    same(a, b)
    got = a.orderBy("t").toPandas()
    s, r = pd.Series(x), pd.Series(y)
    want = {"m": s.rolling(40, min_periods=20).mean(), "s": s.rolling(30).std(), "hi": s.rolling(25).max(), "lo": s.rolling(25).min()}
    for c, v in want.items():
        np.testing.assert_allclose(got[c].astype(float), v, atol=1e-9, err_msg=c)
    for i in range(34, 260):
        w = s[i - 34 : i + 1]
        assert (np.isnan(got["d"][i]) and w.isna().any()) or got["d"][i] == 34 - int(np.argmax(w.to_numpy()))
    for i in range(39, 260):
        pair = pd.DataFrame({"x": s, "y": r})[i - 29 : i + 1]
        flat = pair["x"].nunique() == 1
        want_co = np.nan if pair.isna().any().any() or flat else pair["x"].corr(pair["y"])
        np.testing.assert_allclose(got["co"][i] if got["co"][i] is not None else np.nan, want_co, atol=1e-8)
        assert np.isnan(got["sk"][i]) == (s[i - 29 : i + 1].isna().any() or flat)
    assert (got["s"][149:160] == 0).all()


@pytest.mark.parametrize("rows", [31, 50_000])
def test_expanding_z_over_blocks(spark, rows):
    x = walk(200, 8)
    x[:40], x[77] = np.nan, np.nan
    flat = np.full(200, 3.3)
    df = frame(spark, {"x": x, "flat": flat})
    cur = blocks.blocks(df, ENT, T, rows).drop("_own").withColumns({"_a": F.col("x"), "_b": F.col("flat")})
    got = expanding_z_columns(cur, {"z": "_a", "zf": "_b"}, ENT, rows < 200, 20).orderBy("t").toPandas()
    s = pd.Series(x)
    want = (s - s.expanding().mean()) / s.expanding().std()
    np.testing.assert_allclose(got["z"].astype(float), want.where((s.expanding().count() >= 20) & s.notna()), atol=1e-9)
    assert got["zf"].isna().all()


def test_features_are_the_same_for_any_block_length(spark, many_ranges):
    n = 700
    raw = {c: walk(n, 20 + i) for i, c in enumerate(["sp500_close", "vix_close", "vxv_close", "yield_10y", "yield_10y_3m", "hy_spread", "cpi", "initial_claims", "unemployment_rate", "oil_wti", "dollar_twi", "v6_tlt", "baa_10y_spread"])}
    raw["hy_spread"][:] = np.nan
    df = frame(spark, raw).union(frame(spark, {c: v[:300][::-1] for c, v in raw.items()}, "b"))
    same(features.build_features(df, ENT, T, rows=150), features.build_features(df, ENT, T), atol=1e-7, rtol=1e-6)


def test_base_rate_and_driver_are_the_same_for_any_block_length(spark, many_ranges):
    g = np.random.default_rng(9)
    y = (g.random(500) < 0.3).astype(float)
    y[100:180] = np.nan
    p = g.random(500)
    df = frame(spark, {"p": p, "y": y})
    a, b = (pool.live_base_rate(df, "p", "y", 5, 0.2, ENT, T, 60, 7, 30, rows) for rows in (64, 50_000))
    same(a, b)
    got, last = values(a, "base_rate_live"), 0.2
    for i in range(500):
        past = y[max(0, i - 65) : max(0, i - 5)]
        if i % 7 == 0 and (~np.isnan(past)).sum() >= 30:
            last = np.nanmean(past)
        assert got[i] == pytest.approx(last)
    d = frame(spark, {c: walk(300, 40 + i) for i, c in enumerate("uvw")})
    same(*(engines.dominant_driver(d, ["u", "v", "w"], ENT, T, 40, rows=rows) for rows in (33, 50_000)))


@pytest.mark.parametrize("kind", ["skill", "none", "against", "rare"])
def test_remap_is_the_optimum_whatever_the_outcomes_are(spark, many_ranges, kind):
    g = np.random.default_rng(10)
    n, h, window, every, least = 700, 10, 300, 21, 100
    p = g.uniform(0.001, 0.999, n)
    y = (g.random(n) < {"skill": p, "none": np.full(n, 0.5), "against": 1 - p, "rare": np.full(n, 0.02)}[kind]).astype(float)
    got = np.array(values(pool.adaptive_remap(frame(spark, {"p": p, "y": y}), "p", "y", h, ENT, T, window, every, least, rows=84), "remapped"))
    x = np.log(p / (1 - p))
    refits = 0
    for i in range(0, n, every):
        past = slice(max(0, i - h - window), max(0, i - h))
        if len(y[past]) < least or not 0 < y[past].mean() < 1:
            np.testing.assert_allclose(got[i : i + every], p[i : i + every])
            continue
        a, b = np.polyfit(x[i : i + every], np.log(got[i : i + every] / (1 - got[i : i + every])), 1)
        q = 1 / (1 + np.exp(-(a * x[past] + b)))
        assert abs(((q - y[past]) * x[past]).sum() + a) < 1e-5 and abs((q - y[past]).sum()) < 1e-5
        refits += 1
    assert refits > 20
    if kind == "none":
        assert 0.3 < got[200:].mean() < 0.7 and got[200:].min() > 0.05 and got[200:].max() < 0.95


def test_logistic_fit_settles_where_full_newton_steps_run_away():
    g = np.random.default_rng(11)
    for i in range(200):
        x, y = g.normal(0, 3, 1260), (g.random(1260) < [0.5, 0.02, 0.98, 0.3][i % 4]).astype(float)
        a, b = pool.logistic_fit(x, y)
        q = 1 / (1 + np.exp(-(a * x + b)))
        assert abs(((q - y) * x).sum() + a) < 1e-4 and abs((q - y).sum()) < 1e-4
