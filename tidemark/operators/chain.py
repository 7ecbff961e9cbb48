"""From features to the gate: engines fitted up to a day, pooled, scored over a range, walked forward and judged."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import Ent, order
from tidemark.operators import engines as en, folds as fo, pool as po, validation as va
from tidemark.operators.episodes import drawdown_episodes, normal_days
from tidemark.operators.features import FEATURES
from tidemark.operators.labels import crash_label, forward_maxdd
from tidemark.sources.staging import stage

ENGINES = tuple(po.ENGINES)
#: Folds, or engines of a fold, whose jobs run side by side.
AT_ONCE = 4
LAYERS = ["layer1", "archetype", "layer2", "layer3"]


@dataclass(frozen=True)
class Setup:
    """Label (drawdown of x_pct % within h rows), analogs per query, what counts as a normal day, and whether the posterior follows the times."""

    x_pct: float = 10.0
    h: int = 63
    neighbours: int = 50
    normal_x: float = 10.0
    min_normal: int = en.MIN_NORMAL
    hmm_rounds: int = 100
    gate: po.GateConfig = po.GateConfig()
    remap: bool = False
    reanchor: bool = False


@dataclass(frozen=True)
class Analog:
    """Whitening of the training rows, and the pool of those whose outcome was known by the last training day."""

    scaler: en.Scaler
    mean: np.ndarray
    cov: np.ndarray
    pool: DataFrame = field(repr=False)
    radii: DataFrame = field(repr=False)

    def whiten(self, df: DataFrame, ent: Ent, t: str) -> DataFrame:
        names = [f"z_{c}" for c in self.scaler.columns]
        z = en.apply_imputer_scaler(df, self.scaler).withColumn("_id", F.xxhash64(*ent, t))
        return en.analog_whiten(z, names, self.mean, self.cov).drop(*names)


@dataclass(frozen=True)
class Fitted:
    """Engines that could be fitted by name; `errors` names the others with the reason."""

    until: str
    setup: Setup
    engines: dict = field(repr=False)
    errors: dict[str, str]


@dataclass(frozen=True)
class Scored:
    """Scored rows and what the pooling learned from the training rows."""

    rows: DataFrame = field(repr=False)
    base_rate: float
    skill: dict[str, float]
    weights: dict[str, float]
    gate: po.GateConfig
    errors: dict[str, str]


def side_by_side(f: Callable, items: Sequence) -> list:
    """`f` of every item, in threads that each send their own Spark jobs: small jobs then share the cluster instead of queueing."""
    with ThreadPoolExecutor(max(1, min(AT_ONCE, len(items)))) as pool:
        return list(pool.map(f, items))


def _attempt(calls: dict[str, Callable], errors: dict[str, str]) -> dict:
    """Results of the calls, whose jobs run side by side; one that has too little data (TooLittleData, a singular matrix) is recorded and left out."""

    def attempt(call: Callable):
        try:
            return call(), None
        except (en.TooLittleData, np.linalg.LinAlgError) as e:
            return None, f"{type(e).__name__}: {e}"

    results = dict(zip(calls, side_by_side(attempt, list(calls.values()))))
    errors |= {name: why for name, (_, why) in results.items() if why}
    done = {name: found for name, (found, why) in results.items() if not why}
    if not done:
        raise en.TooLittleData(f"no engine has enough data: {errors}")
    return done


def _fit_anomaly(train: DataFrame, setup: Setup, ent: Ent, t: str) -> en.Anomaly:
    falls = drawdown_episodes(train.select(*ent, t, "_price"), "_price", setup.normal_x, ent, t)
    normal = stage(normal_days(train, falls, ent, t).filter("normal").drop("normal"), "normal")
    return en.anomaly_fit(normal, FEATURES, setup.min_normal)


def _fit_analog(train: DataFrame, setup: Setup, ent: Ent, t: str) -> Analog:
    scaler = en.fit_imputer_scaler(train, FEATURES)
    if len(scaler.columns) < en.MIN_FEATURES:
        raise en.TooLittleData("too few usable columns")
    mean, cov, _ = en.ledoit_wolf_cov(en.apply_imputer_scaler(train, scaler), [f"z_{c}" for c in scaler.columns])
    horizons = sorted({*en.HORIZONS, setup.h})
    known = en.analog_pool(train, "_price", ent, t, horizons)
    bare = Analog(scaler, mean, cov, train, train)
    pool = stage(bare.whiten(known, ent, t).select("_id", t, "w", *[f"dd_{h}" for h in horizons]), "pool")
    if pool.isEmpty():
        raise en.TooLittleData("no row's outcome is known at the longest horizon")
    radii = stage(en.analog_reference_radii(pool, setup.neighbours, "_id", t, ["_id"], max(horizons)), "radii")
    return Analog(scaler, mean, cov, pool, radii)


def fit_until(features: DataFrame, raw: DataFrame, until: str, setup: Setup, ent: Ent, t: str) -> Fitted:
    """The four engines fitted on rows up to `until` (inclusive) alone.

    `features` is `build_features`' result, `raw` the indicators of the same keys. An engine
    with too little history is recorded in `errors` and its weight goes to the others; that
    none can be fitted is a ValueError.
    """
    last = F.lit(until).cast("date")
    train, errors = stage(features.filter(F.col(t) <= last), "train"), {}
    found = _attempt({
        "anomaly": lambda: _fit_anomaly(train, setup, ent, t),
        "regime": lambda: en.hmm_fit(train, en.HMM_FEATURES, ent, t, rounds=setup.hmm_rounds),
        "analog": lambda: _fit_analog(train, setup, ent, t),
        "causal": lambda: en.chosen_assets(raw.filter(F.col(t) <= last)),
    }, errors)
    return Fitted(until, setup, found, errors)


def engine_outputs(model: Fitted, features: DataFrame, raw: DataFrame, ent: Ent, t: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(outputs of the fitted engines by name, errors). Each row is scored from itself and rows before it."""
    m, s, errors = model.engines, model.setup, dict(model.errors)
    keys = [*ent, t]

    def analog() -> DataFrame:
        a: Analog = m["analog"]
        queries = stage(a.whiten(features, ent, t).select(*keys, "_id", "w"), "queries")
        found = en.analog_knn(queries, a.pool, f"dd_{s.h}", s.x_pct, s.h, s.neighbours, "_id", t, a.radii)
        return queries.select(*keys, "_id").join(found, "_id", "left").select(*keys, "prob", "confidence")

    runs = {
        "anomaly": lambda: en.anomaly_score(features, m["anomaly"]).select(*keys, "ensemble_rank"),
        "regime": lambda: en.hmm_horizon(en.hmm_filter(features, m["regime"], ent, t), m["regime"], s.h).select(*keys, "stress_score", "h_step_stress_prob"),
        "analog": analog,
        "causal": lambda: en.causal_score(raw, ent, t, model.until, assets=m["causal"]).select(*keys, "stress_composite"),
    }
    return _attempt({e: runs[e] for e in ENGINES if e in m}, errors), errors


def known_panel(features: DataFrame, x_pct: float, h: int, ent: Ent, t: str) -> DataFrame:
    """Keys, price, layers, the label `_y` and the day `_known` on which it was known. No row reads later ones but for its label, so one table serves all folds."""
    labelled = forward_maxdd(features, "_price", h, ent, t, "_dd").withColumns({"_y": crash_label("_dd", x_pct), "_known": F.lead(t, h).over(order(ent, t))})
    return stage(po.layers(labelled, ent, t).select(*ent, t, "_price", "_y", "_known", *LAYERS), "known-panel")


@dataclass(frozen=True)
class Fold:
    """A fitted model, what its engines say of the rows up to `end`, and the rows [start, end] asked for."""

    model: Fitted
    outputs: dict[str, DataFrame] = field(repr=False)
    errors: dict[str, str]
    start: str | None
    end: str | None


def run_engines(model: Fitted, features: DataFrame, raw: DataFrame, ent: Ent, t: str, start: str | None = None, end: str | None = None) -> Fold:
    if end is not None:
        features, raw = (df.filter(F.col(t) <= F.lit(end).cast("date")) for df in (features, raw))
    return Fold(model, *engine_outputs(model, features, raw, ent, t), start, end)


def _pressures(f: int, fold: Fold, base: DataFrame, ent: Ent, t: str) -> DataFrame:
    """The fold's rows with pressures, `y` known by its end, `y_fit` known by its last training day, and the analogs' support."""
    keys, by = [*ent, t], lambda day: F.col("_known") <= F.lit(day).cast("date")
    rows = base.withColumns({"y": F.col("_y") if fold.end is None else F.when(by(fold.end), F.col("_y")), "y_fit": F.when(by(fold.model.until), F.col("_y"))})
    rows = rows if fold.end is None else rows.filter(F.col(t) <= F.lit(fold.end).cast("date"))
    out = po.join_engines(fold.outputs, rows.drop("_y", "_known"), keys)
    if "analog" in fold.outputs:
        out = out.join(fold.outputs["analog"].select(*keys, po.clip(F.col("confidence"), 0.0, 1.0).alias("_support")), keys)
    else:
        out = out.withColumn("_support", F.lit(0.5))
    train = F.col(t) <= F.lit(fold.model.until).cast("date")
    return out.withColumns({"_fold": F.lit(f), "_train": train})


def score_folds(folds: dict[int, Fold], base: DataFrame, ent: Ent, t: str) -> dict[int, Scored]:
    """Every fold's rows of [start, end] with pooled posterior, confidence, layers, gate and its reason.

    All folds go through calibration, pooling, the Platt map, live base rates, confidence and
    the tuning of the gate together: the fold is a key of each aggregate, so the number of jobs
    doesn't grow with the folds. A fold's pressures are calibrated, weighted and pooled by its
    training rows whose label is known on its last training day; the same rows set its final map
    and thresholds. Without such rows its pressures are pooled as they are, with equal weights
    and a prior of 0.5. Folds share one Setup. With `remap` the posterior is refitted on what
    was known at each block of rows, with `reanchor` it is moved to the live base rate.
    """
    s = next(iter(folds.values())).model.setup
    joined = stage(reduce(DataFrame.unionByName, [_pressures(f, fold, base, ent, t) for f, fold in folds.items()]), "pressures")
    prior, skill, weights, calibrated = _calibrate(joined, list(folds), t)
    weight = {e: fo.of_key({f: weights[f][e] for f in folds}, "_fold") for e in ENGINES}
    at = fo.of_key(prior, "_fold")
    pooled = stage(po.log_odds_pool(joined.withColumns(calibrated), weight, at), "pooled")
    pooled = pooled.withColumn("posterior", fo.apply_platt(F.col("posterior"), fo.platt_calibrate(pooled, "_fold", "posterior", "y_fit", t), "_fold"))
    by = ["_fold", *ent]
    pooled = po.live_base_rate(pooled, "posterior", "y", s.h, at, by, t)
    if s.remap:
        pooled = po.adaptive_remap(pooled, "posterior", "y", s.h, by, t).withColumn("posterior", F.col("remapped")).drop("remapped")
    if s.reanchor:
        pooled = pooled.withColumn("posterior", po.reanchor_prior(F.col("posterior"), F.col("base_rate_live"), at))
    pooled = stage(po.confidence(pooled, ENGINES, at, "_support"), "scored")
    gates = fo.tune_gate(pooled.filter("_train"), "_fold", s.gate, prior)
    kept = [*ent, t, "_price", "y", "posterior", "base_rate_live", "confidence", *LAYERS, "fires", "reason", *[f"{k}_{e}" for k in ("pressure", "calibrated", "contribution") for e in ENGINES]]
    done = {}
    for f, fold in folds.items():
        out = pooled.filter(F.col("_fold") == f)
        if fold.start:
            out = out.filter(F.col(t) >= F.lit(fold.start).cast("date"))
        out = po.contributions(po.gate_reason(po.gate(out, gates[f]), gates[f]), weights[f], prior[f])
        out = out.select(*kept).withColumns({"x_pct": F.lit(float(s.x_pct)), "horizon": F.lit(s.h)})
        done[f] = Scored(out, prior[f], skill[f], weights[f], gates[f], fold.errors)
    return done


def score(model: Fitted, features: DataFrame, raw: DataFrame, ent: Ent, t: str, start: str | None = None, end: str | None = None) -> Scored:
    """`score_folds` of one model. Rows after `end` change nothing; the live base rate reads labels that are `h` rows old."""
    fold = run_engines(model, features, raw, ent, t, start, end)
    return score_folds({1: fold}, known_panel(features, model.setup.x_pct, model.setup.h, ent, t), ent, t)[1]


def _calibrate(joined: DataFrame, folds: list[int], t: str) -> tuple[dict[int, float], dict[int, dict[str, float]], dict[int, dict[str, float]], dict[str, Column]]:
    """(prior, skill and weights by fold, calibrated_<engine> expressions) from rows with y_fit."""
    fit = joined.filter("y_fit IS NOT NULL")
    rates = {r["_fold"]: float(r["y"]) for r in fit.groupBy("_fold").agg(F.avg("y_fit").alias("y")).collect()}
    prior = {f: min(max(rates[f], po.P_MIN), po.P_MAX) if f in rates else 0.5 for f in folds}
    name = lambda e: F.concat_ws("|", F.col("_fold"), F.lit(e))
    cells = F.array(*[F.struct(name(e).alias("key"), F.col(f"pressure_{e}").alias("p")) for e in ENGINES])
    long = stage(fit.select(t, F.col("y_fit").alias("y"), F.explode(cells).alias("x")).select(t, "y", "x.*").filter("p IS NOT NULL"), "known")
    skills, bins = side_by_side(lambda f: f(), [lambda: fo.engine_skill(long, "key", "p", "y", t), lambda: fo.fit_bins(long, "key", "p", "y")])
    skill = {f: {e: skills.get(f"{f}|{e}", 0.0) for e in ENGINES} for f in folds}
    weights = {f: po.bounded_weights(skill[f]) if f in rates else {e: 1 / len(ENGINES) for e in ENGINES} for f in folds}
    calibrated = {}
    for e in ENGINES:
        own = {f: bins[f"{f}|{e}"] for f in folds if f"{f}|{e}" in bins}
        calibrated[f"calibrated_{e}"] = fo.apply_bins(F.col(f"pressure_{e}"), own, "_fold")
    return prior, skill, weights, calibrated


def fit_and_score(features: DataFrame, raw: DataFrame, until: str, setup: Setup, ent: Ent, t: str, start: str | None = None, end: str | None = None) -> Scored:
    return score(fit_until(features, raw, until, setup, ent, t), features, raw, ent, t, start, end)


def walk_forward(features: DataFrame, raw: DataFrame, cutoffs: Sequence[str], setup: Setup, ent: Ent, t: str) -> tuple[DataFrame, dict[int, Scored], dict[int, str]]:
    """(rows with `fold`, models by fold, reasons of skipped folds).

    Per cutoff everything is fitted anew on the days before it, and the window up to the next
    cutoff (both days in) is scored. Engines of AT_ONCE folds send their jobs to the cluster at a
    time; labels and layers are built once, and all that follows the engines runs for all folds
    together (`score_folds`). `validation.pool_folds` makes the windows disjoint.
    """

    def fold(i: int) -> Fold | en.TooLittleData:
        eve = (dt.date.fromisoformat(cutoffs[i]) - dt.timedelta(days=1)).isoformat()
        try:
            return run_engines(fit_until(features, raw, eve, setup, ent, t), features, raw, ent, t, cutoffs[i], cutoffs[i + 1] if i + 1 < len(cutoffs) else None)
        except en.TooLittleData as e:
            return e

    results = dict(enumerate(side_by_side(fold, range(len(cutoffs))), 1))
    folds = {f: r for f, r in results.items() if isinstance(r, Fold)}
    skipped = {f: str(r) for f, r in results.items() if f not in folds}
    if not folds:
        raise en.TooLittleData(f"no fold could be scored: {skipped}")
    done = score_folds(folds, known_panel(features, setup.x_pct, setup.h, ent, t), ent, t)
    rows = reduce(DataFrame.unionByName, [m.rows.withColumn("fold", F.lit(f)) for f, m in done.items()])
    return rows, done, skipped


def report(rows: DataFrame, weights: dict[int, dict[str, float]], setup: Setup, ent: Ent, t: str) -> DataFrame:
    """Metrics of fires and probabilities per (fold, entity) with the verdict of `kill_check`; `weights` by fold."""
    by = ["fold", *ent]
    fires = F.coalesce(F.col("fires"), F.lit(False))
    heaviest = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, max(w.values()))])
    parts = [
        va.calibration_summary(rows, "posterior", "y", by).drop("base_rate"), va.lead_times(rows, fires, "_price", setup.x_pct, setup.h, by, t),
        va.backtest(rows, fires, "_price", by, t),
    ]
    one = reduce(lambda a, b: a.join(b, by, "left"), parts, va.confusion(rows, fires, "y", by))
    return va.kill_check(one.withColumn("max_weight", heaviest[F.col("fold")]))


def validate(features: DataFrame, raw: DataFrame, cutoffs: Sequence[str], setup: Setup, ent: Ent, t: str) -> DataFrame:
    """`report` of every fold, and as fold 0 of the folds pooled (a boundary day once, the last fold's weights)."""
    rows, models, _ = walk_forward(features, raw, cutoffs, setup, ent, t)
    rows = stage(rows, "folds")
    weights = {f: m.weights for f, m in models.items()}
    pooled = va.pool_folds(rows, ent, t).withColumn("fold", F.lit(0))
    return report(rows.unionByName(pooled), weights | {0: weights[max(weights)]}, setup, ent, t)


def blind(features: DataFrame, raw: DataFrame, boundary: str, setup: Setup, ent: Ent, t: str) -> tuple[DataFrame, Scored]:
    """(report, model) of the rows from `boundary` on, fitted on the days before it."""
    rows, models, _ = walk_forward(features, raw, [boundary], setup, ent, t)
    return report(rows, {1: models[1].weights}, setup, ent, t), models[1]
