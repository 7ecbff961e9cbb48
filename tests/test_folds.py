"""Pooling by fold: each fold's numbers are those of `pool` on its rows alone, and the options that follow the times."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles
from tidemark.operators import chain, folds, pool
from tidemark.sources.staging import stage

ENT, T = ["ent"], "t"
SCHEMA = "fold int, ent string, t date, p double, y double, layer1 double, layer2 double, layer3 double, posterior double, confidence double, base_rate_live double"


@pytest.fixture(scope="module")
def rows(spark):
    """Fold 1 has skill, 2 none, 3 few rows, 4 one outcome, 5 a constant p, 6 only null outcomes."""
    g = np.random.default_rng(8)
    out = []
    for f, n in ((1, 900), (2, 700), (3, 60), (4, 400), (5, 500), (6, 300)):
        x = g.normal(size=n)
        y = (g.random(n) < (1 / (1 + np.exp(-1.5 * x + 1)) if f == 1 else 0.3)).astype(float)
        p = np.full(n, 0.4) if f == 5 else np.round(1 / (1 + np.exp(-x)), 2)
        for i in range(n):
            target = None if f == 6 or i % 17 == 0 else 0.0 if f == 4 else float(y[i])
            a, b, c = (float(v) for v in g.random(3) * 3)
            out.append((f, "ab"[i % 2], dt.date(2000, 1, 1) + dt.timedelta(days=i // 2), None if i % 23 == 0 else float(p[i]), target, a, b, c, float(p[i]), float(g.random()), 0.3 if f == 2 else 0.2 + 0.1 * float(g.random())))
    return spark.createDataFrame(out, SCHEMA).repartition(5).cache()


def one(rows, f):
    return rows.filter(F.col("fold") == f)


def test_bins_of_every_fold_equal_those_of_its_rows(rows):
    got = folds.fit_bins(rows, "fold", "p", "y")
    assert set(got) == {1, 2, 3, 4, 5}
    for f, bins in got.items():
        want = pool.fit_bins(one(rows, f), "p", "y")
        assert bins.edges == want.edges and bins.base == pytest.approx(want.base) and bins.rates == pytest.approx(want.rates)
    both = rows.select("fold", "p", folds.apply_bins(F.col("p"), got, "fold").alias("v")).collect()
    assert all(r["v"] == r["p"] for r in both if r["fold"] == 6)
    alone = {(r["p"], r["v"]) for f in (1, 4) for r in one(rows, f).select("p", pool.apply_bins(F.col("p"), got[f]).alias("v")).collect()}
    assert {(r["p"], r["v"]) for r in both if r["fold"] in (1, 4)} == alone


def test_skill_of_every_fold_equals_that_of_its_rows(rows):
    got = folds.engine_skill(rows, "fold", "p", "y", T)
    assert got[1] > 0.05 and got[3] == 0.0 and 6 not in got
    for f, s in got.items():
        assert s == pytest.approx(pool.engine_skill(one(rows, f), "p", "y", ENT, T), abs=1e-12)


def test_platt_of_every_fold_equals_that_of_its_rows(rows):
    got = folds.platt_calibrate(rows, "fold", "p", "y", T)
    assert {f for f, m in got.items() if m.slope is None} == {3, 4}
    for f in (1, 2, 5):
        want = pool.platt_calibrate(one(rows, f), "p", "y", ENT, T)
        assert (got[f].slope, got[f].intercept, got[f].temper, got[f].prior) == pytest.approx((want.slope, want.intercept, want.temper, want.prior), abs=1e-6)
    applied = rows.select("fold", "p", folds.apply_platt(F.col("p"), got, "fold").alias("v"))
    assert applied.filter("fold IN (3, 4, 6) AND NOT v <=> p").isEmpty()
    alone = one(rows, 1).select("p", got[1].apply(F.col("p")).alias("want")).distinct()
    assert applied.filter("fold = 1").distinct().join(alone, "p").filter("abs(v - want) > 1e-12").isEmpty()


def test_gate_of_every_fold_equals_that_of_its_rows(rows):
    cfg = pool.GateConfig(confidence=0.1, layer3=0.1)
    base = {1: 0.3, 2: 0.3, 3: 0.25, 9: 0.5}
    got = folds.tune_gate(rows, "fold", cfg, base)
    assert got[9] == cfg and got[1].source == got[2].source == "tuned" and got[1].lift and got[2].lift is None
    for f in (1, 2, 3):
        assert got[f] == pool.tune_gate(one(rows, f), cfg, base[f])


def test_quantiles_of_long_groups_equal_those_gathered(rows, monkeypatch):
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    take = lambda: {r["fold"]: r["q"] for r in quantiles.grouped_quantiles(rows, ["fold"], F.col("p"), shares).collect()}
    gathered = take()
    monkeypatch.setattr(quantiles, "VALUES_IN_TASK", 10)
    ranked = take()
    assert set(ranked) == set(gathered)
    for f, q in ranked.items():
        x = [r["p"] for r in one(rows, f).collect() if r["p"] is not None]
        assert q == pytest.approx(gathered[f], abs=1e-12) and q == pytest.approx(list(np.quantile(x, shares)), abs=1e-12)


def test_no_rows_give_no_entries(rows):
    none = rows.filter("fold < 0")
    assert folds.fit_bins(none, "fold", "p", "y") == folds.engine_skill(none, "fold", "p", "y", T) == folds.platt_calibrate(none, "fold", "p", "y", T) == {}
    cfg = pool.GateConfig()
    assert folds.tune_gate(none, "fold", cfg, {1: 0.5}) == {1: cfg}


def test_posterior_can_follow_the_live_base_rate_and_the_lagged_map(spark):
    g, n, h, day = np.random.default_rng(4), 700, 5, lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    x = g.normal(size=n)
    y = (g.random(n) < 1 / (1 + np.exp(-x - np.where(np.arange(n) > 350, 1.5, -1.5)))).astype(float)
    base = spark.createDataFrame(
        [("a", day(i), 1.0, float(y[i]) if i + h < n else None, day(i + h) if i + h < n else None, float(x[i]), "credit_led", float(x[i]), 3.0) for i in range(n)],
        "ent string, t date, _price double, _y double, _known date, layer1 double, archetype string, layer2 double, layer3 double",
    )
    outputs = {"causal": spark.createDataFrame([("a", day(i), float(1 / (1 + np.exp(-x[i])))) for i in range(n)], "ent string, t date, stress_composite double")}

    def scored(start=None, **options):
        setup = chain.Setup(h=h, **options)
        return chain.score_folds({7: chain.Fold(chain.Fitted(day(400).isoformat(), setup, {}, {}), outputs, {}, start, day(650).isoformat())}, base, ENT, T)[7]

    plain = scored()
    was = stage(plain.rows.select("ent", "t", "y", "posterior", "base_rate_live"), "plain")
    assert was.agg(F.count("posterior"), F.max("t"), F.max(F.when(F.col("y").isNotNull(), F.col("t")))).first()[0:] == (651, day(650), day(645))
    assert plain.base_rate == pytest.approx(y[:396].mean()) and plain.skill["anomaly"] == 0.0
    got = scored(day(300).isoformat(), reanchor=True).rows.select("ent", "t", F.col("posterior").alias("got"))
    both = was.join(got, ["ent", "t"])
    assert both.count() == 351 and both.filter(F.abs(pool.reanchor_prior(F.col("posterior"), F.col("base_rate_live"), plain.base_rate) - F.col("got")) > 1e-9).isEmpty()
    want = pool.adaptive_remap(was, "posterior", "y", h, ENT, T).select("ent", "t", "posterior", F.col("remapped").alias("want"))
    both = want.join(scored(remap=True).rows.select("ent", "t", F.col("posterior").alias("got")), ["ent", "t"])
    assert both.count() == 651 and both.filter("abs(want - got) > 1e-9").isEmpty() and not both.filter("abs(got - posterior) > 1e-3").isEmpty()
