"""What pooling learns, for all folds at once: the fold (or fold and engine) is a key of every aggregate.

A fold's numbers are those that `pool`'s functions give on its rows alone; a pass over the rows
serves all folds. Keys are few (folds times engines); per key only edges, rates, coefficients
and thresholds come to the driver, and they go back into the rows' expressions as literal maps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import grouped_quantiles
from tidemark.operators import pool as po
from tidemark.sources.staging import stage


def _literal(v, kind: str) -> Column:
    if v is None:
        return F.lit(None).cast(kind)
    return F.array(*[F.lit(float(x)) for x in v]).cast(kind) if kind.startswith("array") else F.lit(v).cast(kind)


def of_key(values: dict, key: str, kind: str = "double") -> Column:
    """The value of the row's key (int or string), as `kind`; null for a key without one."""
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.create_map(*[c for k, v in values.items() for c in (F.lit(k), _literal(v, kind))]), F.col(key))


def _at_or_below(x: Column, edges: Column, strict: bool = False) -> Column:
    """Number of edges at (unless strict) or below x."""
    return F.size(F.filter(edges, (lambda e: x > e) if strict else (lambda e: x >= e)))


def quantiles_of(df: DataFrame, key: str, value: Column, shares: Sequence[float]) -> dict:
    return {r[key]: list(r["q"]) for r in grouped_quantiles(df, [key], value, shares).collect()}


def fit_bins(df: DataFrame, key: str, p: str, y: str, n_bins: int = 10, min_rows: int = 50) -> dict[object, po.Bins]:
    """`pool.fit_bins` per key; a key without rows has no entry."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    heads = {r[key]: (r["n"], float(r["base"])) for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("base")).collect()}
    edges = {k: sorted(set(q)) for k, q in quantiles_of(rows, key, F.col(p), [i / n_bins for i in range(n_bins + 1)]).items()}
    inner = {k: tuple(e[1:-1]) for k, e in edges.items() if heads[k][0] >= min_rows and heads[k][1] not in (0.0, 1.0) and len(e) >= 3}
    binned = rows.withColumn("_b", _at_or_below(F.col(p), of_key(inner, key, "array<double>"))).filter(F.col(key).isin(list(inner)))
    found = {(r[key], r["_b"]): (r["hits"], r["n"]) for r in binned.groupBy(key, "_b").agg(F.sum(y).alias("hits"), F.count(F.lit(1)).alias("n")).collect()} if inner else {}
    rate = lambda k, i: (1 + found.get((k, i), (0, 0))[0]) / (2 + found.get((k, i), (0, 0))[1])
    return {k: po.Bins(inner[k], tuple(rate(k, i) for i in range(len(inner[k]) + 1)), base) if k in inner else po.Bins((), (), base) for k, (_, base) in heads.items()}


def apply_bins(p: Column, bins: dict[object, po.Bins], key: str) -> Column:
    """The rate of the bin of the row's key; null stays null, and a key without bins keeps p."""
    edges = of_key({k: b.edges for k, b in bins.items()}, key, "array<double>")
    rates = of_key({k: b.rates or (b.base,) for k, b in bins.items()}, key, "array<double>")
    return F.when(p.isNotNull(), F.coalesce(F.element_at(rates, _at_or_below(p, edges) + 1), p))


def engine_skill(df: DataFrame, key: str, p: str, y: str, t: str, min_rows: int = 50) -> dict[object, float]:
    """`pool.engine_skill` per key; a key without rows has no entry."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("_day", F.unix_date(F.col(t).cast("date")))
    sizes = {r[key]: r["count"] for r in rows.groupBy(key).count().collect()}
    middle = {k: q[0] for k, q in quantiles_of(rows, key, F.col("_day"), [0.5]).items()}
    halves = rows.withColumn("_early", F.col("_day") <= of_key(middle, key))
    bins = fit_bins(halves.filter("_early"), key, p, y)
    base = of_key({k: b.base for k, b in bins.items()}, key)
    late = halves.filter("NOT _early").groupBy(key).agg(
        F.avg(po.log_loss(apply_bins(F.col(p), bins, key), F.col(y))).alias("own"), F.avg(po.log_loss(base, F.col(y))).alias("base"),
    )
    found = {r[key]: max(0.0, 1 - r["own"] / r["base"]) if r["base"] else 0.0 for r in late.collect()}
    return {k: found.get(k, 0.0) if n // 2 >= min_rows else 0.0 for k, n in sizes.items()}


def _logistic(rows: DataFrame, key: str, keys: Sequence, x: Column, y: Column, parts: Sequence[Column], used: np.ndarray, rounds: int = 50) -> np.ndarray:
    """(keys, parts, 2): slope and intercept per key over the rows of each part that `used` names, penalty slope^2 / 2.

    A Newton round is one aggregate by key of five sums per part.
    """
    fits = np.zeros((len(keys), len(parts), 2))
    for _ in range(rounds):
        at = of_key({k: fits[i].ravel() for i, k in enumerate(keys)}, key, "array<double>")
        sums = []
        for j, part in enumerate(parts):
            q = 1 / (1 + F.exp(-(F.element_at(at, 2 * j + 1) * x + F.element_at(at, 2 * j + 2))))
            for name, term in (("gx", (q - y) * x), ("g", q - y), ("hxx", q * (1 - q) * x * x), ("hx", q * (1 - q) * x), ("h", q * (1 - q))):
                sums.append(F.sum(F.when(part, term)).alias(f"{name}{j}"))
        found = {r[key]: r for r in rows.groupBy(key).agg(*sums).collect()}
        steps = np.zeros_like(fits)
        for i, k in enumerate(keys):
            for j in np.flatnonzero(used[i]):
                s = {n: found[k][f"{n}{j}"] or 0.0 for n in ("gx", "g", "hxx", "hx", "h")}
                steps[i, j] = np.linalg.solve([[s["hxx"] + 1, s["hx"]], [s["hx"], s["h"] + 1e-9]], [s["gx"] + fits[i, j, 0], s["g"]])
        far = np.abs(steps).max(axis=2, keepdims=True)
        fits -= steps * np.minimum(1.0, 4.0 / np.maximum(far, 1e-300))
        if far.max() < 1e-9:
            break
    return fits


def platt_calibrate(df: DataFrame, key: str, p: str, y: str, t: str, blocks: int = 4, min_rows: int = 200) -> dict[object, po.Platt]:
    """`pool.platt_calibrate` per key; all keys' fits, whole and without a block, share their passes. A key without rows has no entry."""
    day = F.unix_date(F.col(t).cast("date"))
    known = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    rows = stage(known.select(key, day.alias("_day"), po.logit(F.col(p)).alias("_l"), F.col(y).cast("double").alias("_y")), "platt")
    heads = {r[key]: (r["n"], r["hits"]) for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("hits")).collect()}
    out = {k: po.Platt(None) for k in heads}
    keys = sorted(k for k, (n, hits) in heads.items() if n >= min_rows and 0 < hits < n)
    if not keys:
        return out
    cuts = quantiles_of(rows.filter(F.col(key).isin(keys)), key, F.col("_day"), [i / blocks for i in range(1, blocks)])
    rows = stage(rows.filter(F.col(key).isin(keys)).withColumn("_block", _at_or_below(F.col("_day"), of_key(cuts, key, "array<double>"), strict=True)), "platt-blocks")
    sizes = {(r[key], r["_block"]): (r["n"], r["hits"]) for r in rows.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("hits")).collect()}
    used = np.ones((len(keys), blocks + 1), bool)
    for i, k in enumerate(keys):
        for b in range(blocks):
            n, hits = (whole - part for whole, part in zip(heads[k], sizes.get((k, b), heads[k])))
            used[i, 1 + b] = n >= min_rows and 0 < hits < n
    fits = _logistic(rows, key, keys, F.col("_l"), F.col("_y"), [F.lit(True), *[F.col("_block") != b for b in range(blocks)]], used)
    fitted = of_key({k: np.where(used[i][:, None], fits[i], np.nan).ravel() for i, k in enumerate(keys)}, key, "array<double>")
    outside = po.sigmoid(F.element_at(fitted, 2 * F.col("_block") + 3) * F.col("_l") + F.element_at(fitted, 2 * F.col("_block") + 4))
    slopes = rows.select(key, F.nanvl(outside, F.lit(None).cast("double")).alias("_q"), "_y").groupBy(key).agg(F.regr_slope("_y", "_q").alias("s"))
    temper = {r[key]: r["s"] for r in slopes.collect()}
    for i, k in enumerate(keys):
        s = temper.get(k)
        out[k] = po.Platt(*map(float, fits[i, 0]), temper=1.0 if s is None else min(1.0, max(0.15, s)), prior=heads[k][1] / heads[k][0])
    return out


def apply_platt(p: Column, maps: dict[object, po.Platt], key: str) -> Column:
    """The map of the row's key; a key without one, or with one that passes p through, keeps p."""
    told = {k: m for k, m in maps.items() if m.slope is not None}
    slope, intercept, temper, at = (of_key(v, key) for v in (
        {k: m.slope for k, m in told.items()}, {k: m.intercept for k, m in told.items()}, {k: m.temper for k, m in told.items()},
        {k: float(np.log(m.prior / (1 - m.prior))) for k, m in told.items()},
    ))
    return F.when(slope.isNull(), p).otherwise(po.sigmoid(at + temper * (slope * po.logit(p) + intercept - at)))


def tune_gate(df: DataFrame, key: str, cfg: po.GateConfig, base_rates: dict[object, float]) -> dict[object, po.GateConfig]:
    """`pool.tune_gate` per key of `base_rates`: the whole grid of every key in one aggregate."""
    names = ["layer1", "layer2", "posterior"]
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select(key, "x.*")
    at = {(r[key], r["c"]): list(r["q"]) for r in grouped_quantiles(long, [key, "c"], F.col("v"), cfg.quantiles).collect()}
    told = [k for k in base_rates if all((k, c) in at for c in names)]
    spread = {r[key]: r["s"] or 0.0 for r in df.groupBy(key).agg(F.stddev_samp("base_rate_live").alias("s")).collect()}

    def config(k, i: int, lift: float | None) -> po.GateConfig:
        a, b, p = (at[k, c][i] for c in names)
        return po.GateConfig(**{**cfg.__dict__, "layer1": a, "layer2": b, "lift": lift, "posterior": cfg.posterior if lift else max(p, cfg.min_posterior, base_rates[k]), "source": "tuned"})

    grids = {k: [config(k, i, lift) for i in range(len(cfg.quantiles)) for lift in (cfg.lifts if spread[k] > 1e-9 else (None,))] for k in told}
    best = {k: cfg for k in base_rates}
    for moving in (True, False):  # the two kinds of key have grids of other lengths
        some = [k for k in told if (spread[k] > 1e-9) == moving]
        if not some:
            continue
        of = lambda name, i: of_key({k: grids[k][i].__dict__[name] for k in some}, key)
        rates = []
        for i in range(len(grids[some[0]])):
            cell = po.GateConfig(**{**grids[some[0]][i].__dict__, "layer1": of("layer1", i), "layer2": of("layer2", i), "posterior": of("posterior", i)})
            rates.append(F.avg(reduce(lambda a, x: a & x[1], po._checks(cell), F.lit(True)).cast("double")).alias(f"r{i}"))
        for r in df.filter(F.col(key).isin(some)).groupBy(key).agg(*rates).collect():
            top = None
            for i, cell in enumerate(grids[r[key]]):
                rate = r[f"r{i}"] or 0.0
                rank = (rate >= cfg.target_rate, -rate if rate >= cfg.target_rate else rate)
                if cfg.min_rate <= rate <= cfg.max_rate and (top is None or rank > top[0]):
                    top = (rank, cell)
            best[r[key]] = top[1] if top else cfg
    return best
