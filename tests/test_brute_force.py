"""Queries without SQL against plain versions: models, calibration, gate, oversampling and streams."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import panel, values
from tidemark.functions import quantiles, vec
from tidemark.operators import engines, pool, validation
from tidemark.streaming import jobs

ENT, T = ["ent"], "t"
COLS = ["a", "b", "c"]


def cloud(n=200, seed=1):
    g = np.random.default_rng(seed)
    return g.normal(size=(n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1.0]]) + [3, 0, -1]


def frame(spark, x, columns=COLS):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ", ".join(["id int", *(f"{c} double" for c in columns)]))


def column(df, name):
    return np.array([r[name] for r in df.orderBy("id").collect()], float)


def test_mahalanobis_equals_its_definition(spark):
    x = cloud()
    mean, cov = x.mean(0), np.cov(x.T)
    got = column(engines.mahalanobis_score(frame(spark, x), COLS, mean, cov), "mahalanobis")
    np.testing.assert_allclose(got, [(r - mean) @ np.linalg.solve(cov, r - mean) for r in x], rtol=1e-9)


def test_whitened_distances_are_mahalanobis_distances(spark):
    x = cloud(40)
    mean, cov = x.mean(0), np.cov(x.T)
    w = np.array([r["w"] for r in engines.analog_whiten(frame(spark, x), COLS, mean, cov).orderBy("id").collect()])
    for i, j in itertools.combinations(range(40), 2):
        d = x[i] - x[j]
        assert ((w[i] - w[j]) ** 2).sum() == pytest.approx(d @ np.linalg.solve(cov, d), rel=1e-8)


def plain_path(tree, row):
    at = 0
    while tree[at][0] >= 0:
        f, cut, left, right = tree[at]
        at = left if row[f] < cut else right
    return tree[at][1]


def expected_path(n):
    """Mean unsuccessful search depth by its harmonic sum; the operator uses the logarithm's approximation."""
    return 2 * sum(1 / i for i in range(1, n)) - 2 * (n - 1) / n


def test_isolation_scores_equal_walks_down_the_trees(spark):
    x = np.vstack([cloud(300), [[30, -30, 30]]])
    df = frame(spark, x)
    forest, rows = engines.isolation_forest(df, COLS, trees=30, rows=64)
    got = column(engines.isolation_forest_score(df, COLS, forest, rows), "isolation")
    norm = 2 * (math.log(rows - 1) + 0.5772156649015329) - 2 * (rows - 1) / rows
    assert norm == pytest.approx(expected_path(rows), rel=0.02)
    np.testing.assert_allclose(got, [2 ** (-np.mean([plain_path(t, r) for t in forest]) / norm) for r in x], rtol=1e-9)
    assert len(forest) == 30 and rows == 64 and got.argmax() == 300
    again, _ = engines.isolation_forest(df.repartition(7), COLS, trees=30, rows=64)
    assert again == forest  # the draw depends on the rows alone


def test_anomaly_ranks_and_alerts_equal_counting(spark):
    columns = [*COLS, "d", "e"]
    x = np.hstack([cloud(150), cloud(150, 2)[:, :2]])
    fit, new = frame(spark, x[:120], columns), frame(spark, np.vstack([x[120:], [[40] * 5]]), columns)
    model = engines.anomaly_fit(fit, columns, min_normal=100)
    got = engines.anomaly_score(new, model).orderBy("id").toPandas()
    z = lambda a: (a - x[:120].mean(0)) / x[:120].std(0)
    for name, plain in (
        ("mahalanobis", lambda a: np.array([(r - model.mean) @ np.linalg.solve(model.cov, r - model.mean) for r in z(a)])),
        ("isolation", lambda a: np.array([2 ** (-np.mean([plain_path(t, r) for t in model.forest]) / vec.average_path(model.rows)) for r in z(a)])),
    ):
        ref, own = plain(x[:120]), plain(np.vstack([x[120:], [[40] * 5]]))
        np.testing.assert_allclose(got[f"{name}_rank"].astype(float), [(ref < v - 1e-12).mean() for v in own], atol=1e-12)
    np.testing.assert_allclose(got["ensemble_rank"].astype(float), (got["mahalanobis_rank"] + got["isolation_rank"]).astype(float) / 2)
    assert got["anomaly_alert"].tolist() == (got["ensemble_rank"] >= 0.99).tolist() and got["anomaly_alert"].iloc[-1]
    with pytest.raises(ValueError):
        engines.anomaly_fit(fit, columns, min_normal=121)


START, TRANS = np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]])
MEANS, COVS = np.array([[0.0, 0.0], [1.5, 1.0]]), np.array([[[0.5, 0.1], [0.1, 0.4]], [[1.0, 0.0], [0.0, 0.8]]])


def density(x, m, c):
    d = x - m
    return math.exp(-0.5 * d @ np.linalg.solve(c, d)) / math.sqrt((2 * math.pi) ** len(d) * np.linalg.det(c))


def all_paths(x, start=START, trans=TRANS, means=MEANS, covs=COVS):
    """(state path, joint density) for every path."""
    for path in itertools.product(range(len(start)), repeat=len(x)):
        p = start[path[0]]
        for i, s in enumerate(path):
            p *= (trans[path[i - 1], s] if i else 1) * density(x[i], means[s], covs[s])
        yield path, p


def hmm_model(columns=("a", "b")):
    return engines.Hmm(engines.Scaler(tuple(columns), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0)), START, TRANS, MEANS, COVS)


def two_series(seed=3, n=7):
    g = np.random.default_rng(seed)
    return {e: g.normal(0.7, 1, (n, 2)) for e in "pq"}


def long(spark, series):
    days = pd.date_range("2020-01-01", periods=400).date
    return spark.createDataFrame([(e, days[i], *map(float, r)) for e, x in series.items() for i, r in enumerate(x)], "ent string, t date, a double, b double")


def test_filtered_posteriors_equal_sums_over_all_paths(spark):
    series = two_series()
    got = engines.hmm_filter(long(spark, series), hmm_model(), ENT, T).orderBy("ent", "t").toPandas()
    for e, x in series.items():
        mine = got[got["ent"] == e][["p_0", "p_1"]].to_numpy()
        for i in range(len(x)):
            mass = np.zeros(2)
            for path, p in all_paths(x[: i + 1]):
                mass[path[-1]] += p
            np.testing.assert_allclose(mine[i], mass / mass.sum(), rtol=1e-9)


def plain_em(series, rounds, start, trans, means, covs, ridge):
    k = len(start)
    for _ in range(rounds):
        n0, moves, n, sx, sxx, ll = np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros_like(means), np.zeros_like(covs), 0.0
        for x in series:
            total = sum(p for _, p in all_paths(x, start, trans, means, covs))
            ll += math.log(total)
            for path, p in all_paths(x, start, trans, means, covs):
                n0[path[0]] += p / total
                for i, s in enumerate(path):
                    n[s] += p / total
                    sx[s] += p / total * x[i]
                    sxx[s] += p / total * np.outer(x[i], x[i])
                    if i:
                        moves[path[i - 1], s] += p / total
        start, trans, means = n0 / n0.sum(), moves / moves.sum(1, keepdims=True), sx / n[:, None]
        covs = sxx / n[:, None, None] - np.array([np.outer(m, m) for m in means]) + ridge * np.eye(means.shape[1])
    return start, trans, means, covs, ll


def test_em_equals_sums_over_all_paths(spark):
    series = two_series()
    m = engines.hmm_fit(long(spark, series), ["a", "b"], ENT, T, n_states=2, rounds=2, tol=-np.inf)
    x = np.vstack(list(series.values()))
    z = {e: (s - x.mean(0)) / x.std(0) for e, s in series.items()}
    rows = np.vstack(list(z.values()))
    high = rows[:, 0] > np.median(rows[:, 0])
    means = np.array([rows[~high].mean(0), rows[high].mean(0)])
    want = plain_em(list(z.values()), 2, np.full(2, 0.5), np.array([[0.95, 0.05], [0.05, 0.95]]), means, np.tile(np.eye(2), (2, 1, 1)), 1e-3)
    for a, b in zip((m.start, m.trans, m.means, m.covs, m.loglik), want):
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-7)
    roles = engines.hmm_states(m, "a")
    assert roles["calm"] == [int(np.argmin(m.means[:, 0]))] and roles["crisis"] == roles["stress"] == [int(np.argmax(m.means[:, 0]))]


def test_probabilities_ahead_equal_steps_of_the_chain(spark):
    post = engines.hmm_filter(long(spark, two_series()), hmm_model(), ENT, T)
    for h in (1, 5):
        for r in engines.hmm_horizon(post, hmm_model(), h).collect():
            p = np.array([r["p_0"], r["p_1"]])
            for _ in range(h):
                p = np.array([sum(p[i] * TRANS[i, j] for i in range(2)) for j in range(2)])
            assert r["h_step_crisis_prob"] == r["h_step_stress_prob"] == pytest.approx(p[1])
            assert r["state"] == int(r["p_1"] > r["p_0"]) and r["stress_score"] == r["p_1"]


def test_connectedness_and_causal_stress_equal_pandas(spark):
    names, n = ["x", "y", "z"], 30
    g = np.random.default_rng(5)
    s = pd.DataFrame(g.normal(size=(120, 3)) @ np.array([[1, 0.6, 0], [0, 1, 0], [0.3, 0, 1]]), columns=names)
    days = pd.date_range("2020-01-01", periods=120).date
    df = spark.createDataFrame([("a", d, *map(float, r)) for d, r in zip(days, s.to_numpy())], "ent string, t date, x double, y double, z double")
    corr = engines.connectedness(engines.rolling_corr_matrix(df, names, ENT, T, n), names)
    base = engines.baseline_corr(df, names)
    corr = engines.structure_break(corr, names, base)
    train = corr.filter(F.col("t") < F.lit(days[90]))
    got = engines.causal_stress(corr, train).orderBy("t").toPandas()
    full, share, gap = s.corr().to_numpy(), np.full(120, np.nan), np.full(120, np.nan)
    for i in range(n, 120):
        c = s.iloc[i - n : i].corr().to_numpy()
        e = np.linalg.eigvalsh(np.abs(c))
        share[i], gap[i] = e[-1] / e.sum(), np.linalg.norm(c - full)
    np.testing.assert_allclose(got["connectedness"].astype(float), share, rtol=1e-7)
    np.testing.assert_allclose(got["structure_break"].astype(float), gap, rtol=1e-6)
    rank = lambda v: np.array([np.nan if np.isnan(x) else (v[n:90] < x - 1e-9).mean() for x in v])
    np.testing.assert_allclose(got["stress_composite"].astype(float), (rank(share) + rank(gap)) / 2, atol=1e-9)


def test_isotonic_equals_the_min_max_form(spark):
    g = np.random.default_rng(6)
    p = np.round(g.random(80), 2)
    y = (g.random(80) < p).astype(float)
    rows = [*zip(range(80), p.tolist(), y.tolist()), (80, 0.5, None), (81, None, 1.0)]
    got = {r["id"]: r["isotonic"] for r in pool.isotonic_calibrate(spark.createDataFrame(rows, "id int, p double, y double"), "p", "y").collect()}
    at = sorted(set(p))
    sums, counts = np.array([y[p == v].sum() for v in at]), np.array([(p == v).sum() for v in at])
    mean = lambda i, j: sums[i : j + 1].sum() / counts[i : j + 1].sum()
    fit = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    np.testing.assert_allclose([got[i] for i in range(80)], [fit[at.index(v)] for v in p], atol=1e-9)
    assert got[81] is None and 0 <= got[80] <= 1


def test_isotonic_merges_ranges_and_pieces(spark):
    g = np.random.default_rng(16)
    p = np.round(g.random(3_000), 3)
    y = (g.random(3_000) < p**2).astype(float)
    df = spark.createDataFrame([*zip(range(3_000), p.tolist(), y.tolist()), (3_000, -1.0, None), (3_001, 2.0, None)], "id int, p double, y double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = pool.isotonic_blocks(df, "p", "y", fan_in=2).orderBy("lo").collect()
        got = {r["id"]: r["isotonic"] for r in pool.isotonic_calibrate(df, "p", "y", rows=5).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(blocks) > 10 and sum(r["w"] for r in blocks) == 3_000
    mean = {v: y[(p >= r["lo"]) & (p <= r["hi"])].mean() for r in blocks for v in np.unique(p[(p >= r["lo"]) & (p <= r["hi"])])}
    rates = [mean[r["lo"]] for r in blocks]
    assert all(a < b for a, b in zip(rates, rates[1:]))
    for r in blocks:  # no block could be cut into two with rising means
        inside = (p >= r["lo"]) & (p <= r["hi"])
        for v in np.unique(p[inside])[:-1]:
            assert y[inside & (p <= v)].mean() >= y[inside & (p > v)].mean() - 1e-12
    np.testing.assert_allclose([got[i] for i in range(3_000)], [mean[v] for v in p], atol=1e-12)
    assert got[3_000] == rates[0] and got[3_001] == rates[-1]


def test_remap_is_the_optimum_on_the_lagged_window(spark):
    g = np.random.default_rng(8)
    n, h, window, every, least = 260, 10, 120, 21, 50
    p = g.uniform(0.05, 0.95, n)
    y = (g.random(n) < 0.2 + 0.5 * p).astype(float)
    days = pd.date_range("2020-01-01", periods=n).date
    df = spark.createDataFrame([("a", d, float(u), float(v)) for d, u, v in zip(days, p, y)], "ent string, t date, p double, y double")
    got = np.array(values(pool.adaptive_remap(df, "p", "y", h, ENT, T, window, every, least), "remapped"))
    x, z = np.log(p / (1 - p)), np.log(got / (1 - got))
    for i in range(0, n, every):
        past = slice(max(0, i - h - window), max(0, i - h))
        if len(y[past]) < least:
            np.testing.assert_allclose(got[i : i + every], p[i : i + every])
            continue
        a, b = np.polyfit(x[i : i + every], z[i : i + every], 1)
        q = 1 / (1 + np.exp(-(a * x[past] + b)))
        # the penalised log loss is convex: no slope at the map means it is the minimum
        assert abs(((q - y[past]) * x[past]).sum() + a) < 1e-6 and abs((q - y[past]).sum()) < 1e-6


@pytest.mark.parametrize("moving", [True, False])
def test_tuned_gate_equals_a_loop_over_the_grid(spark, moving):
    g = np.random.default_rng(9)
    n = 600
    v = {"posterior": g.random(n), "confidence": g.random(n), "layer1": g.normal(1, 1, n), "layer2": g.normal(0, 1, n), "layer3": g.uniform(0, 20, n), "base_rate_live": g.uniform(0.2, 0.4, n) if moving else np.full(n, 0.3)}
    df = spark.createDataFrame(pd.DataFrame(v))
    cfg = pool.GateConfig()
    got = pool.tune_gate(df, cfg, 0.3)
    best = None
    for q in cfg.quantiles:
        l1, l2, p = (np.quantile(v[c], q) for c in ("layer1", "layer2", "posterior"))
        for lift in cfg.lifts if moving else (None,):
            top = (v["posterior"] >= lift * v["base_rate_live"]) & (v["posterior"] >= cfg.min_posterior) if lift else v["posterior"] >= max(p, cfg.min_posterior, 0.3)
            rate = (top & (v["confidence"] >= cfg.confidence) & (v["layer1"] >= l1) & (v["layer2"] >= l2) & (v["layer3"] >= cfg.layer3)).mean()
            key = (1, -rate) if rate >= cfg.target_rate else (0, rate)
            if cfg.min_rate <= rate <= cfg.max_rate and (best is None or key > best[0]):
                best = (key, l1, l2, lift)
    if best is None:
        assert got == cfg
    else:
        assert (got.layer1, got.layer2, got.lift, got.source) == (pytest.approx(best[1]), pytest.approx(best[2]), best[3], "tuned")


def test_new_rows_lie_between_a_row_and_a_near_one(spark):
    g = np.random.default_rng(10)
    few, many = g.normal(size=(17, 2)), g.normal(5, 1, (60, 2))
    rows = [("a", *map(float, r), 1) for r in few] + [("a", *map(float, r), 0) for r in many]
    rows += [(None, 1.0, 2.0, 1)] * 6 + [(None, float(i), 0.0, 0) for i in range(9)]  # nothing but copies
    rows += [("one", 1.0, 1.0, 1)] * 20 + [("rare", 1.0, 1.0, 1)] * 5 + [("rare", float(i), 1.0, 0) for i in range(9)] + [("a", None, 1.0, None)]
    df = spark.createDataFrame(rows, "ent string, u double, v double, y int")
    out = validation.smote_oversample(df, ["u", "v"], "y", ENT)
    got = out.filter("synthetic").collect()
    assert out.filter("NOT synthetic").count() == len(rows) and {r["ent"] for r in got} == {"a", None} and {r["y"] for r in got} == {1}
    assert sum(r["ent"] == "a" for r in got) == 43 and [(r["u"], r["v"]) for r in got if r["ent"] is None] == [(1.0, 2.0)] * 3
    d = np.sqrt(((few[:, None] - few[None]) ** 2).sum(-1))
    near = np.argsort(d, axis=1)[:, 1:6]
    starts = []
    for r in got:
        if r["ent"] == "a":
            z = np.array([r["u"], r["v"]])
            fits = [i for i in range(17) for j in near[i] if abs(np.linalg.norm(z - few[i]) + np.linalg.norm(z - few[j]) - d[i, j]) < 1e-9]
            assert fits
            starts.append(fits)
    assert len({i for f in starts for i in f}) == 17  # 43 new rows: each of 17 starts two or three
    again = validation.smote_oversample(df.repartition(5), ["u", "v"], "y", ENT).filter("synthetic").collect()
    order = lambda rs: sorted((r["ent"] or "", r["u"], r["v"]) for r in rs)
    assert order(again) == order(got)


def test_neighbours_within_groups_and_cells(spark, monkeypatch):
    monkeypatch.setattr(engines, "QUERY_ROWS", 11)
    monkeypatch.setattr(engines, "POOL_ROWS", 7)
    g = np.random.default_rng(12)
    x, kind = g.normal(size=(90, 3)), np.repeat(["p", "q"], [70, 20])
    df = spark.createDataFrame([(i, str(k), r.tolist()) for i, (k, r) in enumerate(zip(kind, x))], "id int, kind string, w array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for within, far in (([], d), (["kind"], np.where(kind[:, None] == kind[None], d, np.inf))):
        got = engines.nearest(df, df, 4, None, "id", None, keep=["id"], within=within).orderBy("id", "rank").collect()
        assert [r["pool_id"] for r in got] == np.argsort(far, axis=1)[:, :4].ravel().tolist()


def test_neighbours_by_cells_equal_brute_force_and_skip_distances(spark, monkeypatch):
    monkeypatch.setattr(engines, "QUERY_ROWS", 60)
    monkeypatch.setattr(engines, "POOL_ROWS", 40)
    g = np.random.default_rng(13)
    x = (g.normal(size=(600, 3)) + 12 * g.integers(0, 4, size=(600, 1))).round(3)
    x[100:220] = x[100]  # copies: at distance 0, so no neighbours of one another
    x[300] = x[301] + 1e-5  # nearer than the product form can tell
    days = pd.date_range("2001-01-01", periods=600).date
    df = spark.createDataFrame([(i, d, r.tolist()) for i, (d, r) in enumerate(zip(days, x))], "id int, t date, w array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[(d <= 1e-8) | (np.abs(np.arange(600)[:, None] - np.arange(600)[None]) <= 9)] = np.inf
    got = engines.nearest(df, df, 5, 9, "id", "t", keep=["id"]).toPandas().sort_values(["id", "rank"])
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(600, 5), np.sort(d, axis=1)[:, :5], rtol=1e-9, atol=1e-12)
    assert np.isclose(d[got["id"], got["pool_id"]], got["distance"]).all() and got.groupby("id")["pool_id"].nunique().eq(5).all()
    assert engines.skipped_share(df, df, 5, 9, "id", "t", keep=["id"]) > 0.5


def test_radii_on_even_directions_send_a_query_to_a_part_once(spark, monkeypatch):
    sent, stage = [], engines.stage
    monkeypatch.setattr(engines, "stage", lambda df, name: sent.append(stage(df, name)) or sent[-1])
    monkeypatch.setattr(engines, "QUERY_ROWS", 700)
    monkeypatch.setattr(engines, "POOL_ROWS", 900)
    g = np.random.default_rng(14)
    x = g.normal(size=(3_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]  # no cell can be ruled out
    x[:40] = x[0]  # copies
    x[40:80] = x[40] + 1e-7 * x[40:80]  # nearer than float32 can tell
    x[80:90] *= 1e5  # rows far out
    x += 50.0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[d <= 1e-8] = np.inf
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(3_000 + i, [None] + r.tolist()[1:]) for i, r in enumerate(x[:30])], "id int, w array<double>")
    got = engines.analog_reference_radii(df, 7, "id", None, ["id"]).toPandas()["radius"]
    np.testing.assert_allclose(np.sort(got), np.sort(np.sort(d, axis=1)[:, 6]), rtol=1e-9)
    assert max(t.count() for t in sent) < 3 * 3_030  # not a row per query and cell


def test_a_cell_full_of_copies_takes_no_step_per_pair():
    import time
    import pyarrow as pa

    w = [[1.0, 2.0, 3.0]]
    table = lambda n, key: pa.table({key: pa.array(range(n), pa.int64()), "_d": pa.array([0] * n), "_w": w * (n - 2) + [[1.0, 2.0, 3.0005], [5.0, 5.0, 5.0]]})
    began = time.time()
    got = engines._cell(2, None, [])(table(2_000, "_q"), table(8_000, "_p"))
    assert time.time() - began < 30 and got.num_rows == 4_000 and min(got.column("distance").to_pylist()) == pytest.approx(5e-4)


def written(df, folder, name):
    """One file `name` in `folder`, from one partition."""
    df.coalesce(1).write.parquet(f"{folder}-{name}")
    part = next((folder.parent / f"{folder.name}-{name}").glob("*.parquet"))
    folder.mkdir(exist_ok=True)
    part.rename(folder / f"{name}.parquet")


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    g = np.random.default_rng(11)
    days = pd.date_range("2024-01-01", periods=60)
    rows = [(e, d.to_pydatetime(), float(v)) for e in ("p", "q") for d, v in zip(days, g.normal(0.7, 1, 60))]
    df = spark.createDataFrame(rows, "ent string, t timestamp, z_x double")
    early, late = df.filter("t < '2024-02-01'"), df.filter("t >= '2024-02-01'")
    model = engines.Hmm(engines.Scaler(("x",), (0.0,), (0.0,), (1.0,)), START, TRANS, MEANS[:, :1], COVS[:, :1, :1])
    make = {
        "hmm": lambda s, f: jobs.stream_hmm_filter(s, model, ["z_x"], ENT, T, folder=f),
        "upsert": lambda s, f: jobs.stream_upsert(s, ENT, T, folder=f),
    }
    want = {"hmm": engines.hmm_filter(df.withColumnRenamed("z_x", "x"), model, ENT, T), "upsert": df.groupBy("ent").agg(F.max_by(F.struct("t", "z_x"), "t").alias("x")).select("ent", "x.*")}
    source = tmp_path / "source"
    written(early, source, "early")
    for name, run in make.items():
        run(jobs.read_stream(spark, str(source)), str(tmp_path / name)).count()
    written(late, source, "late")
    for name, run in make.items():
        for _ in range(2):  # a third run finds nothing new
            got = run(jobs.read_stream(spark, str(source)), str(tmp_path / name)).select(*want[name].columns).orderBy("ent", "t").toPandas()
            pd.testing.assert_frame_equal(got, want[name].orderBy("ent", "t").toPandas(), check_exact=False, rtol=1e-9)


@pytest.mark.parametrize("most", [10**6, 10])
def test_quantiles_equal_numpy_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "VALUES_IN_TASK", most)
    g = np.random.default_rng(13)
    x = pd.DataFrame({"a": g.normal(size=301), "few": g.integers(0, 4, 301).astype(float), "none": np.nan})
    df = spark.createDataFrame([tuple(None if math.isnan(v) else v for v in r) for r in x.to_numpy().tolist()] + [(None, 7.0, None)], "a double, few double, none double").repartition(6)
    shares = [0.0, 0.1, 0.25, 0.5, 2 / 3, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "few", "none"], shares)
    assert got["none"] is None
    np.testing.assert_allclose(got["a"], np.quantile(x["a"], shares), rtol=1e-12)
    np.testing.assert_allclose(got["few"], np.quantile([*x["few"], 7.0], shares), rtol=1e-12)


def test_grouped_medians_equal_pandas(spark):
    g = np.random.default_rng(14)
    x = pd.DataFrame({"k": g.choice(["a", "b", "c"], 400, p=[0.8, 0.19, 0.01]), "v": g.integers(0, 40, 400) / 4.0})
    x.loc[::37, "v"] = np.nan
    rows = [(None if i % 50 == 3 else r.k, None if math.isnan(r.v) else r.v) for i, r in enumerate(x.itertuples())]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["k"]: (r["m"], r["n"]) for r in quantiles.grouped_medians(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], F.col("v"), "m").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in {r[0] for r in rows}:
        v = [b for a, b in rows if a == k and b is not None]
        assert got.get(k) == ((np.median(v), len(v)) if v else None)
