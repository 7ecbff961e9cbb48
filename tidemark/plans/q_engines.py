"""Queries of the engines, pooling and the gate."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import engines as en, pool as po
from tidemark.operators.features import build_features
from tidemark.plans.panels import ENT, POS, RAW, SCORED, T, forward_sql, raw_panel, rounded, scored_panel
from tidemark.plans.q_features import ALL_LEVELS, ALL_OUT, chained, last, pct, z
from tidemark.sources.staging import stage

QUERIES, SQL = {}, {}
W = "(PARTITION BY ent ORDER BY t)"
DIM = [f"e{i}" for i in range(64)]


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def vectors(spark, d):
    """(vec_id, label, e0..e63) from the embeddings; label is the outcome."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIM)])


VEC = "vec AS (SELECT vec_id, label::DOUBLE AS label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(DIM)) + " FROM embeddings)"
STATS = "st AS (SELECT " + ", ".join(f"median({c}) AS m_{c}, avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in DIM) + " FROM vec)"


@query("fit_imputer_scaler", f"WITH {VEC}, {STATS} " + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", round(m_{c}, 6) AS median, round(a_{c}, 6) AS mean, round(s_{c}, 6) AS std FROM st' for c in DIM))
def _(spark, d):
    v = vectors(spark, d)
    s = en.fit_imputer_scaler(v, DIM)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(m).alias("median"), F.lit(a).alias("mean"), F.lit(x).alias("std")) for c, m, a, x in zip(s.columns, s.median, s.mean, s.std)])
    return rounded(v.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.explode(rows).alias("x")).select("x.*"))


@query("apply_imputer_scaler", f"WITH {VEC}, {STATS} SELECT vec_id, " + ", ".join(f"round(({c} - a_{c}) / s_{c}, 6) AS z_{c}" for c in DIM) + " FROM vec, st")
def _(spark, d):
    v = vectors(spark, d)
    return rounded(en.apply_imputer_scaler(v, en.fit_imputer_scaler(v, DIM)).select("vec_id", *[f"z_{c}" for c in DIM]))


LW = """x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM x),
  n AS (SELECT count(*)::DOUBLE AS n FROM embeddings), s AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / any_value(n.n) AS s FROM c a JOIN c b USING (vec_id), n GROUP BY ALL),
  m AS (SELECT sum(s) FILTER (i = j) / 64 AS mu, sum(s * s) AS ss FROM s), f AS (SELECT sum(q * q) AS f FROM (SELECT sum(v * v) AS q FROM c GROUP BY vec_id)),
  k AS (SELECT n, mu, (ss - 64 * mu * mu) / 64 AS delta, (f / n - ss) / (n * 64) AS beta FROM m, f, n), sh AS (SELECT n, mu, CASE WHEN delta <= 0 THEN 0 ELSE greatest(0, least(beta, delta) / delta) END AS shrinkage FROM k)"""


@query("ledoit_wolf_cov", f"WITH {LW} SELECT n::BIGINT AS n, round(shrinkage, 6) AS shrinkage, i::INT AS i, j::INT AS j, round((1 - shrinkage) * s + CASE WHEN i = j THEN shrinkage * mu ELSE 0 END, 6) AS cov FROM s, sh")
def _(spark, d):
    mean, cov, shrink = en.ledoit_wolf_cov(vectors(spark, d), DIM)
    cells = spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(len(DIM)) for j in range(len(DIM))], "i int, j int, cov double")
    one = vectors(spark, d).groupBy().agg(F.count(F.lit(1)).alias("n"))
    return rounded(one.crossJoin(cells).select("n", F.lit(float(shrink)).alias("shrinkage"), "i", "j", "cov"))  # one row x d^2


#: The shrunk covariance as a list of rows, and its inverse by elimination on [C | I], one column a step (it is positive definite).
INVERSE = LW + """, co AS (SELECT i, list((1 - shrinkage) * s + CASE WHEN i = j THEN shrinkage * mu ELSE 0 END ORDER BY j) AS r FROM s, sh GROUP BY i),
  gj AS (SELECT 1 AS k, list(list_concat(r, list_transform(range(64), lambda j: (i = j)::INT::DOUBLE)) ORDER BY i) AS m FROM co UNION ALL
    SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(list_zip(r, m[k]), lambda z: z[1] - r[k] / m[k][k] * z[2]) END) FROM gj WHERE k <= 64),
  pr AS (SELECT i, j, m[i + 1][65 + j] AS p FROM gj, (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) WHERE k = 65)"""


@query("mahalanobis_score", f"""WITH RECURSIVE {INVERSE}, h AS (SELECT vec_id, j, sum(c.v * p) AS h FROM c JOIN pr USING (i) GROUP BY ALL)
  SELECT vec_id, round(sum(h * c.v), 6) AS mahalanobis FROM h JOIN c USING (vec_id) WHERE c.i = h.j GROUP BY vec_id""")
def _(spark, d):
    v = vectors(spark, d)
    mean, cov, _ = en.ledoit_wolf_cov(v, DIM)
    return rounded(en.mahalanobis_score(v, DIM, mean, cov).select("vec_id", "mahalanobis"))


@query("isolation_forest_score")
def _(spark, d):
    v = vectors(spark, d)
    forest, rows = en.isolation_forest(v, DIM)
    return rounded(en.isolation_forest_score(v, DIM, forest, rows).select("vec_id", "isolation"))


@query("rank_vs_reference", f"WITH {VEC}, r AS (SELECT label AS x FROM vec) SELECT vec_id, round((SELECT count(*) FROM r WHERE r.x < vec.e0)::DOUBLE / (SELECT count(*) FROM r), 6) AS rank FROM vec")
def _(spark, d):
    v = vectors(spark, d)
    reference = v.select(F.col("label").alias("e0"))
    return rounded(en.rank_vs_reference(v, "e0", reference).select("vec_id", "rank"))


@query("anomaly_ensemble")
def _(spark, d):
    v = vectors(spark, d)
    model = en.anomaly_fit(v, DIM, min_normal=100)  # the smallest table has fewer rows than the default asks for
    return rounded(en.anomaly_score(v, model).select("vec_id", "mahalanobis_rank", "isolation_rank", "ensemble_rank", "ensemble_confidence", "anomaly_alert"))


def _features(spark, d):
    return stage(build_features(raw_panel(spark, d), ENT, T), "features")


HMM_COLUMNS = list(en.HMM_FEATURES)


def _hmm(spark, d):
    f = _features(spark, d).dropna(subset=HMM_COLUMNS)
    return f, en.hmm_fit(f, HMM_COLUMNS, ENT, T)


@query("hmm_fit")
def _(spark, d):
    f, m = _hmm(spark, d)
    cells = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(float(m.trans[i, i])).alias("stay"), F.lit(float(m.means[i, 0])).alias("mean_rv_21_z")) for i in range(len(m.start))])
    return rounded(f.groupBy("ent").agg(F.count(F.lit(1)).alias("n")).select("ent", "n", F.explode(cells).alias("x")).select("ent", "n", "x.*"))


@query("hmm_states")
def _(spark, d):
    f, m = _hmm(spark, d)
    roles = en.hmm_states(m)
    cells = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(s).alias("state")) for r, ss in roles.items() for s in ss])
    return f.groupBy("ent").agg(F.count(F.lit(1)).alias("n")).select("ent", F.explode(cells).alias("x")).select("ent", "x.*")


@query("hmm_filter")
def _(spark, d):
    f, m = _hmm(spark, d)
    return rounded(en.hmm_filter(f, m, ENT, T))


@query("hmm_horizon")
def _(spark, d):
    f, m = _hmm(spark, d)
    return rounded(en.hmm_horizon(en.hmm_filter(f, m, ENT, T), m).select("ent", "t", "state", "stress_score", "h_step_crisis_prob", "h_step_stress_prob"))


@query("analog_pool", f"WITH {RAW}, pos AS (SELECT ent, t, sp500_close AS px, row_number() OVER {W} AS pos FROM raw), " + ", ".join(forward_sql(h, f"f{h}") for h in en.HORIZONS)
       + " SELECT ent, t, " + ", ".join(f"round(f{h}.dd, 6) AS dd_{h}" for h in en.HORIZONS) + " FROM f21 JOIN f63 USING (ent, t) JOIN f126 USING (ent, t) JOIN f252 USING (ent, t) WHERE f252.dd IS NOT NULL")
def _(spark, d):
    return rounded(en.analog_pool(raw_panel(spark, d).select("ent", "t", "sp500_close"), "sp500_close", ENT, T).select("ent", "t", *[f"dd_{h}" for h in en.HORIZONS]))


def _white(spark, d):
    v = vectors(spark, d)
    mean, cov, _ = en.ledoit_wolf_cov(v, DIM)
    return en.analog_whiten(v, DIM, mean, cov)


@query("analog_whiten")
def _(spark, d):
    return _white(spark, d).select("vec_id", F.transform("w", lambda x: F.round(x, 6)).alias("w"))


def _plain(spark, d):
    return vectors(spark, d).withColumn("w", F.array(*DIM))


DIST = "list_distance(a.w, b.w)"
VECW = "vec AS (SELECT vec_id, label::DOUBLE AS label, embedding::DOUBLE[] AS w FROM embeddings)"
NEAR = VECW + f", nb AS (SELECT a.vec_id, b.vec_id AS other, b.label, {DIST} AS dist FROM vec a JOIN vec b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), nk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS r FROM nb QUALIFY r <= 10)"


@query("analog_knn", f"WITH {NEAR} SELECT vec_id, round(avg((label >= 5)::INT), 6) AS prob, count(*) AS n_neighbours, round(max(dist), 6) AS radius FROM nk GROUP BY vec_id")
def _(spark, d):
    v = _plain(spark, d)
    return rounded(en.analog_knn(v.filter("vec_id % 50 = 0"), v, "label", 5.0, 21, 10, "vec_id", None).drop("confidence"))


@query("analog_reference_radii", f"WITH {VECW}, nb AS (SELECT a.vec_id, {DIST} AS dist FROM vec a JOIN vec b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dist) = 10) SELECT round(dist, 6) AS radius FROM nb")
def _(spark, d):
    return rounded(en.analog_reference_radii(_plain(spark, d), 10, "vec_id", None, ["vec_id"]))


@query("analog_top_n", f"WITH {NEAR} SELECT vec_id, label, round(dist, 6) AS distance, r::INT AS rank FROM nk")
def _(spark, d):
    v = _plain(spark, d)
    return rounded(en.analog_top_n(v.filter("vec_id % 50 = 0"), v.withColumn("pool_id", F.col("vec_id")), "vec_id", None, 21, ["pool_id", "label"], 10).select("vec_id", "label", "distance", "rank"))


ASSETS = ["equity", "vol", "rates", "credit", "liquidity", "oil", "dollar"]
CHANGES = RAW + f""", ch0 AS (SELECT ent, t, {pct('sp500_close', 1)} AS equity, vix_close - lag(vix_close) OVER {W} AS vol, yield_10y - lag(yield_10y) OVER {W} AS rates, baa_10y_spread - lag(baa_10y_spread) OVER {W} AS credit,
  nfci - lag(nfci) OVER {W} AS liquidity, {pct('oil_wti', 1)} AS oil, {pct('dollar_twi', 1)} AS dollar FROM raw), ch AS (SELECT * FROM ch0 WHERE """ + " AND ".join(f"{a} IS NOT NULL" for a in ASSETS) + ")"


def _changes(spark, d):
    return en.asset_changes(raw_panel(spark, d), ENT, T)


@query("asset_changes", f"WITH {CHANGES} SELECT ent, t, " + ", ".join(f"round({a}, 6) AS {a}" for a in ASSETS) + " FROM ch")
def _(spark, d):
    return rounded(_changes(spark, d))


BEFORE = "(PARTITION BY ent ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
PAIRS = en.pairs_of(ASSETS)


@query("rolling_corr_matrix", f"WITH {CHANGES} SELECT ent, t, " + ", ".join(f"round(CASE WHEN count(*) OVER {BEFORE} = 252 THEN corr({a}, {b}) OVER {BEFORE} END, 5) AS c_{a}_{b}" for a, b in PAIRS) + " FROM ch")
def _(spark, d):
    return rounded(en.rolling_corr_matrix(_changes(spark, d), ASSETS, ENT, T).select("ent", "t", *[f"c_{a}_{b}" for a, b in PAIRS]), 5)


@query("connectedness")
def _(spark, d):
    return rounded(en.connectedness(en.rolling_corr_matrix(_changes(spark, d), ASSETS, ENT, T), ASSETS).select("ent", "t", "connectedness"))


BREAK = "sqrt(2 * (" + " + ".join(f"power(corr({a}, {b}) OVER {BEFORE} - (SELECT corr({a}, {b}) FROM ch), 2)" for a, b in PAIRS) + "))"


@query("structure_break", f"WITH {CHANGES} SELECT ent, t, round(CASE WHEN count(*) OVER {BEFORE} = 252 THEN {BREAK} END, 5) AS structure_break FROM ch")
def _(spark, d):
    c, some = _changes(spark, d), ASSETS
    return rounded(en.structure_break(en.rolling_corr_matrix(c, some, ENT, T), some, en.baseline_corr(c, some)).select("ent", "t", "structure_break"), 5)


VARS = ", ".join(f"var_samp({a}) OVER {BEFORE} AS v_{a}" for a in ASSETS)


@query("dominant_driver", f"WITH {CHANGES}, v AS (SELECT ent, t, count(*) OVER {BEFORE} AS n, {VARS} FROM ch) SELECT ent, t, CASE WHEN n = 252 THEN CASE greatest({', '.join('v_' + a for a in ASSETS)}) " + " ".join(f"WHEN v_{a} THEN '{a}'" for a in ASSETS) + " END END AS dominant FROM v")
def _(spark, d):
    return en.dominant_driver(_changes(spark, d), ASSETS, ENT, T).select("ent", "t", "dominant")


@query("causal_stress")
def _(spark, d):
    out = en.causal_score(raw_panel(spark, d), ENT, T, "1998-01-01")
    return rounded(out.select("ent", "t", "connectedness_rank", "structure_break_rank", "stress_composite", "dominant"))


# --- pooling: pressures from the scored panel ---


def _pressures(spark, d):
    df = scored_panel(spark, d)
    outputs = {
        "anomaly": df.select("ent", "t", F.col("p").alias("ensemble_rank")), "regime": df.select("ent", "t", (F.col("tax") / 8).alias("stress_score")),
        "analog": df.filter("n > 2").select("ent", "t", (F.col("qty") / 400).alias("prob")),
    }
    return po.join_engines(outputs, df, ["ent", "t"])


PRESS = SCORED + ", pr AS (SELECT *, greatest(0, least(1, p)) AS pressure_anomaly, greatest(0, least(1, tax / 8)) AS pressure_regime, greatest(0, least(1, qty / 400)) AS pressure_analog, NULL::DOUBLE AS pressure_causal FROM scored WHERE n > 2)"
NAMES = ["anomaly", "regime", "analog", "causal"]
WEIGHTS = {"anomaly": 0.4, "regime": 0.3, "analog": 0.2, "causal": 0.1}
PRIOR = 0.3


@query("join_engines", f"WITH {PRESS} SELECT ent, t, " + ", ".join(f"round(pressure_{e}, 6) AS pressure_{e}" for e in NAMES) + " FROM pr")
def _(spark, d):
    return rounded(_pressures(spark, d).select("ent", "t", *[f"pressure_{e}" for e in NAMES]))


KNOWN = PRESS + ", kn AS (SELECT * FROM pr WHERE y IS NOT NULL), q AS (SELECT quantile_cont(tax, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM kn), ed AS (SELECT list_sort(list_distinct(q)) AS e FROM q), inn AS (SELECT e[2:-2] AS e FROM ed)"
BINNED = KNOWN + ", bi AS (SELECT kn.*, len(list_filter(inn.e, lambda x: x <= tax)) AS bin FROM kn, inn), rt AS (SELECT bin, count(*) AS n, (1 + sum(y)) / (2 + count(*)) AS rate FROM bi GROUP BY bin)"


def _known(spark, d):
    return _pressures(spark, d).filter("y IS NOT NULL")


@query("fit_bins", f"WITH {BINNED} SELECT bin::INT AS bin, n, round(rate, 6) AS rate FROM rt")
def _(spark, d):
    k = _known(spark, d)
    bins = po.fit_bins(k, "tax", "y")
    return rounded(k.groupBy(po.bin_of(F.col("tax"), bins.edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first(po.apply_bins(F.col("tax"), bins)).alias("rate")))


@query("apply_bins", f"WITH {BINNED} SELECT ent, t, round(rate, 6) AS calibrated FROM bi JOIN rt USING (bin)")
def _(spark, d):
    k = _known(spark, d)
    return rounded(k.select("ent", "t", po.apply_bins(F.col("tax"), po.fit_bins(k, "tax", "y")).alias("calibrated")))


def skill_sql(e: str) -> str:
    """CTEs up to sk_<e>(skill): bins of the first half in time, log loss of the second against its base rate."""
    p = f"pressure_{e}"
    loss = lambda q: f"-(y * ln({q}) + (1 - y) * ln(1 - ({q})))"
    clipped = lambda q: f"greatest(1e-4::DOUBLE, least(1 - 1e-4::DOUBLE, {q}))"
    return f""", h_{e} AS (SELECT *, (t - DATE '1970-01-01') <= (SELECT quantile_cont(t - DATE '1970-01-01', 0.5) FROM kn WHERE {p} IS NOT NULL) AS early FROM kn WHERE {p} IS NOT NULL),
  e_{e} AS (SELECT list_sort(list_distinct(quantile_cont({p}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))[2:-2] AS e, avg(y) AS base FROM h_{e} WHERE early),
  b_{e} AS (SELECT h.*, len(list_filter(q.e, lambda x: x <= {p})) AS bin, base FROM h_{e} h, e_{e} q), r_{e} AS (SELECT bin, (1 + sum(y)) / (2 + count(*)) AS rate FROM b_{e} WHERE early GROUP BY bin),
  sk_{e} AS (SELECT greatest(0, 1 - avg({loss(clipped('coalesce(rate, 0.5)'))}) / avg({loss(clipped('base'))})) AS skill FROM b_{e} LEFT JOIN r_{e} USING (bin) WHERE NOT early)"""


@query("engine_skill", f"WITH {KNOWN}{skill_sql('regime')} SELECT ent, count(*) AS n, round(any_value(skill), 6) AS skill FROM kn, sk_regime GROUP BY ent")
def _(spark, d):
    k = _known(spark, d)
    skill = F.lit(po.engine_skill(k, "pressure_regime", "y", ENT, T))
    return rounded(k.groupBy("ent").agg(F.count(F.lit(1)).alias("n")).withColumn("skill", skill))


WEIGHED = KNOWN + "".join(skill_sql(e) for e in NAMES[:3]) + """, w0 AS (SELECT [sqrt(a.skill), sqrt(b.skill), sqrt(c.skill), 0.0::DOUBLE] AS w FROM sk_anomaly a, sk_regime b, sk_analog c),
  w1 AS (SELECT 0 AS i, CASE WHEN list_sum(w) = 0 THEN [0.25, 0.25, 0.25, 0.25]::DOUBLE[] ELSE list_transform(w, lambda x: x / list_sum(w)) END AS w FROM w0
    UNION ALL SELECT i + 1, list_transform(k, lambda x: x / list_sum(k)) FROM (SELECT i, list_transform(w, lambda x: greatest(0.1, least(0.45, x))) AS k FROM w1) WHERE i < 50),
  wt AS (SELECT w FROM w1 WHERE i = CASE WHEN (SELECT list_sum(w) FROM w0) = 0 THEN 0 ELSE 50 END)"""


@query("bounded_weights", f"WITH RECURSIVE {WEIGHED} SELECT ent, count(*) AS n, " + ", ".join(f"round(any_value(w[{i + 1}]), 6) AS {e}" for i, e in enumerate(NAMES)) + " FROM kn, wt GROUP BY ent")
def _(spark, d):
    k = _known(spark, d)
    w = po.bounded_weights({e: po.engine_skill(k, f"pressure_{e}", "y", ENT, T) for e in NAMES[:3]} | {"causal": 0.0})
    return rounded(k.groupBy("ent").agg(F.count(F.lit(1)).alias("n")).withColumns({e: F.lit(x) for e, x in w.items()}))


def _pooled(spark, d):
    cal = {f"calibrated_{e}": F.col(f"pressure_{e}") * 0.8 + 0.1 for e in NAMES}
    return po.log_odds_pool(_pressures(spark, d).withColumns(cal), WEIGHTS, PRIOR)


LOGIT = "ln(greatest(1e-4, least(0.9999, {0})) / (1 - greatest(1e-4, least(0.9999, {0}))))"
PI = math.log(PRIOR / (1 - PRIOR))
EVID = {e: f"({LOGIT.format(f'(pressure_{e} * 0.8 + 0.1)')} - ({PI!r}::DOUBLE))" for e in NAMES[:3]}
POOLED = PRESS + ", po AS (SELECT *, 1 / (1 + exp(-(" + f"{PI!r}::DOUBLE + (0.4 * {EVID['anomaly']} + 0.3 * {EVID['regime']} + 0.2 * {EVID['analog']}) / (0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE)" + "))) AS posterior FROM pr)"


@query("log_odds_pool", f"WITH {POOLED} SELECT ent, t, round(posterior, 6) AS posterior FROM po")
def _(spark, d):
    return rounded(_pooled(spark, d).select("ent", "t", "posterior"))


@query("platt_calibrate")
def _(spark, d):
    df = _pooled(spark, d)
    return rounded(df.select("ent", "t", po.platt_calibrate(df, "posterior", "y", ENT, T).apply(F.col("posterior")).alias("platt")), 4)


@query("isotonic_calibrate", f"""WITH RECURSIVE {POOLED}, v AS (SELECT posterior AS p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS w FROM po WHERE posterior IS NOT NULL AND y IS NOT NULL GROUP BY 1),
  pts AS (SELECT 0 AS k, 0.0::DOUBLE AS s, 0.0::DOUBLE AS w UNION ALL SELECT row_number() OVER o, sum(s) OVER o, sum(w) OVER o FROM v WINDOW o AS (ORDER BY p)),
  hull AS (SELECT 0 AS a, 0 AS k, 0.0::DOUBLE AS s, 0.0::DOUBLE AS w, NULL::DOUBLE AS r UNION ALL
    SELECT any_value(h.k), arg_min(q.k, ((q.s - h.s) / (q.w - h.w), -q.k)), arg_min(q.s, ((q.s - h.s) / (q.w - h.w), -q.k)), arg_min(q.w, ((q.s - h.s) / (q.w - h.w), -q.k)), min((q.s - h.s) / (q.w - h.w))
    FROM hull h JOIN pts q ON q.k > h.k GROUP BY h.k),
  pk AS (SELECT row_number() OVER (ORDER BY p) AS k, p FROM v),
  kn AS (SELECT p AS x, r FROM hull JOIN pk ON pk.k = hull.a + 1 WHERE r IS NOT NULL UNION SELECT p, r FROM hull JOIN pk ON pk.k = hull.k WHERE r IS NOT NULL),
  d AS (SELECT DISTINCT posterior AS p FROM po WHERE posterior IS NOT NULL),
  lo AS (SELECT d.p, x AS x0, r AS r0 FROM d ASOF LEFT JOIN kn ON d.p >= kn.x), hi AS (SELECT d.p, x AS x1, r AS r1 FROM d ASOF LEFT JOIN kn ON d.p <= kn.x),
  iso AS (SELECT p, CASE WHEN r0 IS NULL THEN r1 WHEN r1 IS NULL OR x0 = x1 THEN r0 ELSE r0 + (r1 - r0) * (p - x0) / (x1 - x0) END AS v FROM lo JOIN hi USING (p))
  SELECT ent, t, round(v, 6) AS isotonic FROM po LEFT JOIN iso ON po.posterior = iso.p""")
def _(spark, d):
    return rounded(po.isotonic_calibrate(_pooled(spark, d), "posterior", "y").select("ent", "t", "isotonic"))


@query("live_base_rate", f"""WITH {POOLED}, u AS (SELECT ent, t, row_number() OVER {W} - 1 AS pos, CASE WHEN posterior IS NOT NULL AND y IS NOT NULL THEN y END AS u FROM po),
  b AS (SELECT *, CASE WHEN pos % 21 = 0 AND count(u) OVER w >= 250 THEN avg(u) OVER w END AS r FROM u WINDOW w AS (PARTITION BY ent ORDER BY t ROWS BETWEEN 1281 PRECEDING AND 22 PRECEDING))
  SELECT ent, t, round(coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING), 0.3), 6) AS base_rate_live FROM b""")
def _(spark, d):
    return rounded(po.live_base_rate(_pooled(spark, d), "posterior", "y", 21, 0.3, ENT, T).select("ent", "t", "base_rate_live"))


@query("adaptive_remap")
def _(spark, d):
    return rounded(po.adaptive_remap(_pooled(spark, d), "posterior", "y", 21, ENT, T).select("ent", "t", "remapped"))


@query("reanchor_prior", f"WITH {POOLED} SELECT ent, t, round(1 / (1 + exp(-({LOGIT.format('0.45::DOUBLE')} + {LOGIT.format('posterior')} - {LOGIT.format('0.3::DOUBLE')}))), 6) AS p FROM po")
def _(spark, d):
    return rounded(_pooled(spark, d).select("ent", "t", po.reanchor_prior(F.col("posterior"), F.lit(0.45), 0.3).alias("p")))


CONF = POOLED + ", ev AS (SELECT *, [" + ", ".join(EVID[e] for e in NAMES[:3]) + "] AS e FROM po), cf AS (SELECT *, greatest(1e-4, 1 / (1 + list_stddev_pop(e) / 1.5)) AS agreement, 0.75::DOUBLE AS coverage, greatest(1e-4, pressure_analog) AS support FROM ev)"


@query("confidence", f"WITH {CONF} SELECT ent, t, round(agreement, 6) AS agreement, coverage, round(support, 6) AS support, round(power(agreement * coverage * support, 1.0::DOUBLE / 3), 6) AS confidence FROM cf")
def _(spark, d):
    return rounded(po.confidence(_pooled(spark, d), NAMES, PRIOR, "pressure_analog").select("ent", "t", "agreement", "coverage", "support", "confidence"))


LEVELS, AT = chained(ALL_LEVELS, "raw")
FEATURES_SQL = RAW + LEVELS + ", ft AS (SELECT ent, t, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in ALL_OUT.items()) + f" FROM {AT})"
#: Features that the panel's columns give at all.
GIVEN = {c for c, e in ALL_OUT.items() if e != "NULL"}


def composite_levels(groups: dict[str, list[str]]) -> list[dict[str, str]]:
    """Levels of helper columns that end in one composite per group."""
    used = {g: [c for c in names if c in GIVEN] for g, names in groups.items()}
    first = {f"z_{c}": z(f"-{c}" if c in po.INVERTED else c) for c in sorted({c for cs in used.values() for c in cs})}
    mean = lambda cs: f"({' + '.join(f'coalesce(z_{c}, 0)' for c in cs)}) / nullif({' + '.join(f'(z_{c} IS NOT NULL)::INT' for c in cs)}, 0)"
    return [first, {f"m_{g}": mean(cs) for g, cs in used.items()}, {g: z(f"m_{g}") for g in used}]


def composite_query(groups: dict[str, list[str]]) -> str:
    ctes, at = chained(composite_levels(groups), "ft")
    return f"WITH {FEATURES_SQL}{ctes} SELECT ent, t, " + ", ".join(f"round({g}, 6) AS {g}" for g in groups) + f" FROM {at}"


@query("composite_z", composite_query({"rate_led": po.ARCHETYPES["rate_led"]}))
def _(spark, d):
    return rounded(po.composite_z(_features(spark, d), po.ARCHETYPES["rate_led"], "rate_led", ENT, T).select("ent", "t", "rate_led"))


@query("archetype_scores", composite_query(po.ARCHETYPES))
def _(spark, d):
    return rounded(po.archetype_scores(_features(spark, d), ENT, T).select("ent", "t", *po.ARCHETYPES))


TOPS = [{f"x_{a}": f"max({a}) OVER {last(63)}" for a in po.ARCHETYPES}, {"layer1": "greatest(" + ", ".join(f"x_{a}" for a in po.ARCHETYPES) + ")"}]
LAYERED = chained(composite_levels(po.ARCHETYPES | {"tactical": po.TACTICAL}) + TOPS, "ft")


@query("layers", f"WITH {FEATURES_SQL}{LAYERED[0]} SELECT ent, t, round(layer1, 6) AS layer1, CASE layer1 " + " ".join(f"WHEN x_{a} THEN '{a}'" for a in po.ARCHETYPES)
       + f" END AS archetype, round(max(tactical) OVER {last(10)}, 6) AS layer2, round(-dd_from_252h, 6) AS layer3 FROM {LAYERED[1]}")
def _(spark, d):
    return rounded(po.layers(_features(spark, d), ENT, T).select("ent", "t", "layer1", "archetype", "layer2", "layer3"))


GATE = po.GateConfig(posterior=0.45, confidence=0.3, layer1=4.0, layer2=5.0, layer3=10.0)


def _gated(spark, d):
    df = po.confidence(_pooled(spark, d), NAMES, PRIOR, "pressure_analog").withColumns({"layer1": F.col("tax"), "layer2": F.col("disc"), "layer3": F.col("dd") / 4})
    return po.live_base_rate(df, "posterior", "y", 21, 0.3, ENT, T)


CHECKS = "[" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in (("post", "posterior >= 0.45"), ("conf", "power(agreement * coverage * support, 1.0::DOUBLE / 3) >= 0.3"), ("L1", "tax >= 4"), ("L2", "disc >= 5"), ("L3", "dd / 4 >= 10"))) + "]"
GATED = CONF + f", gt AS (SELECT *, list_filter({CHECKS}, lambda x: x IS NOT NULL) AS failed FROM cf)"


@query("gate", f"WITH {GATED} SELECT ent, t, len(failed) = 0 AS fires FROM gt")
def _(spark, d):
    return po.gate(_gated(spark, d), GATE).select("ent", "t", "fires")


@query("gate_reason", f"WITH {GATED} SELECT ent, t, CASE WHEN len(failed) = 0 THEN 'OK' ELSE array_to_string(failed, ' & ') END AS reason FROM gt")
def _(spark, d):
    return po.gate_reason(_gated(spark, d), GATE).select("ent", "t", "reason")


@query("contributions", f"WITH {POOLED} SELECT ent, t, " + ", ".join(f"round({WEIGHTS[e]}::DOUBLE * {EVID[e]}, 6) AS contribution_{e}" for e in NAMES[:3]) + ", NULL::DOUBLE AS contribution_causal FROM po")
def _(spark, d):
    return rounded(po.contributions(_pooled(spark, d), WEIGHTS, PRIOR).select("ent", "t", *[f"contribution_{e}" for e in NAMES]))


TUNED = po.GateConfig(confidence=0.3)
#: The grid's cells in order, each with its rate of fires. Where the live base rate stands still, a cell has a quantile of the posterior in place of a lift.
TUNE = CONF + """, ur AS (SELECT ent, t, row_number() OVER (PARTITION BY ent ORDER BY t) - 1 AS pos, CASE WHEN posterior IS NOT NULL AND y IS NOT NULL THEN y END AS u FROM po),
  br AS (SELECT *, CASE WHEN pos % 21 = 0 AND count(u) OVER w >= 250 THEN avg(u) OVER w END AS r FROM ur WINDOW w AS (PARTITION BY ent ORDER BY t ROWS BETWEEN 1281 PRECEDING AND 22 PRECEDING)),
  lr AS (SELECT ent, t, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY ent ORDER BY t ROWS UNBOUNDED PRECEDING), 0.3) AS live FROM br),
  ga AS (SELECT cf.*, live, power(agreement * coverage * support, 1.0::DOUBLE / 3) AS confidence, tax AS l1, disc AS l2, dd / 4 AS l3 FROM cf JOIN lr USING (ent, t)),
  qs AS (""" + " UNION ALL ".join(f"SELECT {i} AS qi, quantile_cont(l1, {q}::DOUBLE) AS c1, quantile_cont(l2, {q}::DOUBLE) AS c2, quantile_cont(posterior, {q}::DOUBLE) AS cp FROM ga" for i, q in enumerate(TUNED.quantiles)) + """),
  mv AS (SELECT coalesce(stddev_samp(live), 0) > 1e-9 AS moving FROM ga),
  cl AS (SELECT qi * 100 AS cell, c1, c2, cp, NULL::DOUBLE AS lift FROM qs, mv WHERE NOT moving UNION ALL SELECT qi * 100 + li, c1, c2, cp, lift FROM qs, mv, (VALUES """ + ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(TUNED.lifts)) + f""") AS l(li, lift) WHERE moving),
  hit AS (SELECT cell, c1, c2, ent, coalesce(CASE WHEN lift IS NULL THEN posterior >= greatest(cp, {TUNED.min_posterior}::DOUBLE, 0.3::DOUBLE) ELSE posterior >= lift * live AND posterior >= {TUNED.min_posterior}::DOUBLE END AND confidence >= {TUNED.confidence}::DOUBLE AND l1 >= c1 AND l2 >= c2 AND l3 >= {TUNED.layer3}::DOUBLE, false) AS f FROM ga, cl),
  rt AS (SELECT cell, any_value(c1) AS c1, any_value(c2) AS c2, avg(f::INT) AS rate FROM hit GROUP BY cell),
  bs AS (SELECT * FROM rt WHERE rate BETWEEN {TUNED.min_rate}::DOUBLE AND {TUNED.max_rate}::DOUBLE
    ORDER BY (rate >= {TUNED.target_rate}::DOUBLE) DESC, CASE WHEN rate >= {TUNED.target_rate}::DOUBLE THEN -rate ELSE rate END DESC, cell LIMIT 1)"""


@query("tune_gate", f"WITH {TUNE} SELECT ent, count(*) FILTER (f) AS n_fires, round(bs.c1, 6) AS layer1, round(bs.c2, 6) AS layer2, 'tuned' AS source FROM hit JOIN bs USING (cell) GROUP BY ent, bs.c1, bs.c2")
def _(spark, d):
    df = stage(_gated(spark, d), "gated")
    best = po.tune_gate(df, TUNED, 0.3)
    return rounded(po.gate(df, best).groupBy("ent").agg(F.count_if("fires").alias("n_fires")).withColumns({"layer1": F.lit(float(best.layer1)), "layer2": F.lit(float(best.layer2)), "source": F.lit(best.source)}))


@query("audit_table", f"WITH {POOLED} " + " UNION ALL ".join(
    f"SELECT '{e}' AS engine, 0.1::DOUBLE AS skill, {WEIGHTS[e]}::DOUBLE AS weight, round(avg(pressure_{e} * 0.8 + 0.1), 6) AS mean_calibrated, {GATE.layer1}::DOUBLE AS layer1, {GATE.layer2}::DOUBLE AS layer2, {GATE.layer3}::DOUBLE AS layer3, '{GATE.source}' AS threshold_source FROM po"
    for e in NAMES))
def _(spark, d):
    return rounded(po.audit_table(_pooled(spark, d), {e: 0.1 for e in NAMES}, WEIGHTS, GATE))
