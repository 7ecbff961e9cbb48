"""Pooling of engine pressures into a calibrated probability, and the gate."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import vec
from tidemark.functions.blocks import BLOCK_ROWS, halo, map_blocks, positions, several, with_columns
from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.windows import Ent, expanding_z, last_rows, order, so_far
from tidemark.sources.staging import stage

# Engines with their pressure columns (and fallback), archetypes, inverted features, limits.
ENGINES = {"anomaly": ("ensemble_rank",), "regime": ("h_step_stress_prob", "stress_score"), "analog": ("prob",), "causal": ("stress_composite",)}
ARCHETYPES = {
    "credit_led": ["hy_spread_z", "hy_spread_chg", "ig_spread_z", "nfci", "nfci_credit", "nfci_leverage", "stlfsi_z", "claims_13w_chg_z", "sahm_indicator"],
    "rate_led": ["real_rate_10y", "yc_10y_3m", "yc_10y_2y", "yc_10y_3m_chg", "m2_yoy_z"],
    "valuation_led": ["cape_proxy_z", "ma200_dist", "downside_vol_ratio_63", "acf_20"],
    "shock_led": ["cross_asset_corr_z", "epu_z", "oil_shock_z", "dxy_z"],
}
TACTICAL = ["rv_21_z", "rv_63_z", "vix_z", "vix_term_structure", "vix_shock_5d", "cross_asset_corr_z", "return_dispersion_63", "downside_vol_ratio_63",
            "hy_spread_chg", "iv_rv_gap", "oil_shock_z"]
INVERTED = frozenset(("yc_10y_3m", "yc_10y_2y", "iv_rv_gap", "m2_yoy_z", "ma200_dist", "acf_20"))
P_MIN, P_MAX = 1e-4, 1 - 1e-4
#: Tasks over which the rows of one piece of a map are dealt.
SPREAD = 16


@dataclass(frozen=True)
class GateConfig:
    """Thresholds and tuning grids of the gate; `lift` None means an absolute posterior threshold."""

    posterior: float = 0.60
    confidence: float = 0.50
    layer1: float = 1.5
    layer2: float = 1.5
    layer3: float = 2.0
    lift: float | None = None
    min_posterior: float = 0.35
    target_rate: float = 0.010
    min_rate: float = 0.001
    max_rate: float = 0.10
    lifts: tuple[float, ...] = (1.2, 1.4, 1.6, 1.8, 2.0, 2.25, 2.5, 3.0)
    quantiles: tuple[float, ...] = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
    source: str = "default"


def clip(x: Column, lo: float, hi: float) -> Column:
    """x kept in [lo, hi]; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def clip_p(p: Column) -> Column:
    return clip(p, P_MIN, P_MAX)


def logit(p: Column) -> Column:
    return F.ln(clip_p(p) / (1 - clip_p(p)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def join_engines(outputs: dict[str, DataFrame], features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feature rows with pressure_<engine> in [0, 1]; an absent engine's pressure is null. Present engines join inner."""
    out = features
    for engine, names in ENGINES.items():
        df = outputs.get(engine)
        name = next((n for n in names if df is not None and n in df.columns), None)
        if name is None:
            out = out.withColumn(f"pressure_{engine}", F.lit(None).cast("double"))
        else:
            out = out.join(df.select(*keys, clip(F.col(name).cast("double"), 0.0, 1.0).alias(f"pressure_{engine}")), list(keys))
    return out


@dataclass(frozen=True)
class Bins:
    """Inner edges and smoothed hit rates of quantile bins; no edges: the base rate for all."""

    edges: tuple[float, ...]
    rates: tuple[float, ...]
    base: float


def bin_of(p: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below p: bins are closed on the left."""
    return sum(((p >= float(e)).cast("int") for e in edges), F.lit(0))


def fit_bins(df: DataFrame, p: str, y: str, n_bins: int = 10, min_rows: int = 50) -> Bins:
    """Quantile bins of p with rate (1 + hits) / (2 + n). Under 50 rows, one class or under 3 edges: base rate."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("base")).first()
    base = float(head["base"]) if head["base"] is not None else 0.0
    edges = sorted(set(exact_quantiles(rows, [p], [i / n_bins for i in range(n_bins + 1)])[p] or []))
    if head["n"] < min_rows or base in (0.0, 1.0) or len(edges) < 3:
        return Bins((), (), base)
    inner = tuple(edges[1:-1])
    found = {r["b"]: (r["hits"], r["n"]) for r in rows.groupBy(bin_of(F.col(p), inner).alias("b")).agg(F.sum(y).alias("hits"), F.count(F.lit(1)).alias("n")).collect()}
    return Bins(inner, tuple((1 + found.get(i, (0, 0))[0]) / (2 + found.get(i, (0, 0))[1]) for i in range(len(inner) + 1)), base)


def apply_bins(p: Column, bins: Bins) -> Column:
    """The bin's rate; null stays null."""
    rate = F.element_at(F.array(*[F.lit(float(r)) for r in bins.rates]), bin_of(p, bins.edges) + 1) if bins.rates else F.lit(bins.base)
    return F.when(p.isNotNull(), rate)


def log_loss(p: Column, y: Column, eps: float = P_MIN) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def engine_skill(df: DataFrame, p: str, y: str, ent: Ent, t: str, min_rows: int = 50) -> float:
    """Calibrate on the first half in time, skill = max(0, 1 - log loss / log loss of the base rate) on the second."""
    rows = stage(df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(t, p, y), "skill")  # read by all steps
    n = rows.count()
    if n // 2 < min_rows:
        return 0.0
    day = F.unix_date(F.col(t).cast("date"))
    early = day <= exact_quantiles(rows.select(day.alias("_day")), ["_day"], [0.5])["_day"][0]
    bins = fit_bins(rows.filter(early), p, y)
    base = rows.filter(early).agg(F.avg(y)).first()[0]
    late = rows.filter(~early).agg(F.avg(log_loss(apply_bins(F.col(p), bins), F.col(y))), F.avg(log_loss(F.lit(float(base or 0.0)), F.col(y)))).first()
    return 0.0 if not late[1] else max(0.0, 1 - late[0] / late[1])


def bounded_weights(skill: dict[str, float], floor: float = 0.10, cap: float = 0.45, temper: float = 0.5) -> dict[str, float]:
    """Skill to the power `temper`, normalised and kept in [floor, cap]; equal weights when no engine has skill."""
    raw = np.array([max(s, 0.0) ** temper if s > 0 else 0.0 for s in skill.values()])
    w = np.full(len(raw), 1 / len(raw)) if raw.sum() == 0 else vec.bounded(raw / raw.sum(), floor, cap)
    return dict(zip(skill, w.tolist()))


def number(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def log_odds_pool(df: DataFrame, weights: dict[str, Column | float], prior: Column | float, out: str = "posterior") -> DataFrame:
    """Prior log-odds plus weighted evidence of the engines present; null if none is. Reads calibrated_<engine>."""
    pi = logit(number(prior))
    there = lambda e: F.col(f"calibrated_{e}").isNotNull()
    total = sum((F.when(there(e), number(w)).otherwise(0.0) for e, w in weights.items()), F.lit(0.0))
    evidence = sum((F.when(there(e), number(w) * (logit(F.col(f"calibrated_{e}")) - pi)).otherwise(0.0) for e, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, F.when(total > 0, sigmoid(pi + evidence / total)))


@dataclass(frozen=True)
class Platt:
    """sigmoid(slope * logit(p) + intercept), drawn to the prior by `temper`; slope None passes p through."""

    slope: float | None
    intercept: float = 0.0
    temper: float = 1.0
    prior: float = 0.5

    def apply(self, p: Column) -> Column:
        if self.slope is None:
            return p
        at = math.log(self.prior / (1 - self.prior))
        return sigmoid(at + self.temper * (self.slope * logit(p) + self.intercept - at))


def _logistic(rows: DataFrame, x: Column, y: Column, parts: Sequence[Column], rounds: int = 50) -> list[tuple[float, float]]:
    """(slope, intercept) of y on x over the rows of each part, with penalty slope^2 / 2 on the summed loss.

    Newton steps: a round is one aggregate of five sums per part, for all parts together.
    """
    fits = np.zeros((len(parts), 2))
    for _ in range(rounds):
        sums = []
        for i, (part, (a, b)) in enumerate(zip(parts, fits.tolist())):
            q = 1 / (1 + F.exp(-(a * x + b)))
            for name, term in (("gx", (q - y) * x), ("g", q - y), ("hxx", q * (1 - q) * x * x), ("hx", q * (1 - q) * x), ("h", q * (1 - q))):
                sums.append(F.sum(F.when(part, term)).alias(f"{name}{i}"))
        row = rows.agg(*sums).first()
        steps = np.zeros_like(fits)
        for i, (a, _b) in enumerate(fits):
            at = {n: row[f"{n}{i}"] or 0.0 for n in ("gx", "g", "hxx", "hx", "h")}
            steps[i] = np.linalg.solve([[at["hxx"] + 1, at["hx"]], [at["hx"], at["h"] + 1e-9]], [at["gx"] + a, at["g"]])
        far = np.abs(steps).max(axis=1, keepdims=True)
        fits -= steps * np.minimum(1.0, 4.0 / np.maximum(far, 1e-300))
        if far.max() < 1e-9:
            break
    return [(float(a), float(b)) for a, b in fits]


def platt_calibrate(df: DataFrame, p: str, y: str, ent: Ent, t: str, blocks: int = 4, min_rows: int = 200) -> Platt:
    """Platt map, tempered by how outcomes move with out-of-block probabilities (least squares), in [0.15, 1].

    Blocks are contiguous in time; a block is predicted by the fit of the others when these
    have `min_rows` rows and both outcomes. All fits share their passes over the rows.
    """
    day = F.unix_date(F.col(t).cast("date"))
    rows = stage(df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(day.alias("_day"), logit(F.col(p)).alias("_l"), F.col(y).cast("double").alias("_y")), "platt")
    head = rows.agg(F.count(F.lit(1)), F.avg("_y")).first()
    if head[0] < min_rows or head[1] in (0.0, 1.0):
        return Platt(None)
    cuts = exact_quantiles(rows, ["_day"], [i / blocks for i in range(1, blocks)])["_day"]
    block = sum(((F.col("_day") > c).cast("int") for c in cuts), F.lit(0))
    sizes = {r["b"]: (r["n"], r["hits"]) for r in rows.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("hits")).collect()}
    total = (head[0], sum(h for _, h in sizes.values()))
    rest = {b: (total[0] - n, total[1] - h) for b, (n, h) in sizes.items()}
    used = [b for b, (n, h) in sorted(rest.items()) if n >= min_rows and 0 < h < n]
    whole, *fits = _logistic(rows, F.col("_l"), F.col("_y"), [F.lit(True), *[block != b for b in used]])
    slope = None
    if used:
        outside = reduce(lambda c, x: c.when(block == x[0], sigmoid(x[1][0] * F.col("_l") + x[1][1])), zip(used, fits), F)
        slope = rows.select(outside.alias("_q"), "_y").agg(F.regr_slope("_y", "_q")).first()[0]
    return Platt(*whole, temper=1.0 if slope is None else min(1.0, max(0.15, slope)), prior=float(head[1]))


def pool_adjacent(rows: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators over rows (lowest p, highest p, sum of y, weight) in order of p: blocks with rising means.

    Blocks of pieces can be pooled again, so pieces may be worked on apart and merged.
    """
    stack: list[list[float]] = []
    for lo, hi, s, w in rows.tolist():
        while stack and stack[-1][2] * w >= s * stack[-1][3]:
            before = stack.pop()
            lo, s, w = before[0], s + before[2], w + before[3]
        stack.append([lo, hi, s, w])
    return np.array(stack, float).reshape(-1, 4)


def isotonic_blocks(df: DataFrame, p: str, y: str, fan_in: int = 16) -> DataFrame:
    """(lo, hi, s, w) per block of the isotonic fit. Ranges of p pool their own rows; neighbouring ranges merge, `fan_in` at a time."""
    names = ["lo", "hi", "s", "w"]
    schema = "part bigint, lo double, hi double, s double, w double"
    known = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    values = known.groupBy(F.col(p).cast("double").alias("lo")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
    ranged = values.repartitionByRange("lo").sortWithinPartitions("lo").select(F.spark_partition_id().cast("long").alias("part"), "lo", F.col("lo").alias("hi"), "s", "w")

    def table(part: int, blocks_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks_), part), pa.int64()), *(pa.array(c, pa.float64()) for c in blocks_.T)], names=["part", *names])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = np.zeros((0, 4)), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                held = pool_adjacent(np.concatenate([held, vec.matrix(batch, names)]))
        if len(held):
            yield table(part, held)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.column_stack([rows.column(c).to_numpy() for c in names])
        return pa.Table.from_batches([table(key[0].as_py(), pool_adjacent(x[np.argsort(x[:, 0])]))])

    cur = stage(ranged.mapInArrow(local, schema), "isotonic")
    while (cur.agg(F.max("part")).first()[0] or 0) > 0:
        cur = stage(cur.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInArrow(merge, schema), "isotonic")
    return cur.drop("part")


def isotonic_calibrate(df: DataFrame, p: str, y: str, out: str = "isotonic", rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` with the isotonic map of p, linear between blocks, clipped to [0, 1]; null stays null, and all is null without a row to fit.

    Rows meet the map in pieces of `rows` knots, each piece with the knot behind its last.
    """
    blocks_ = isotonic_blocks(df, p, y)
    ends = blocks_.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") / F.col("w"))).alias("v"))
    knots = stage(positions(ends, [], "x"), "knots")
    cuts = [r["x"] for r in knots.filter((F.col("_pos") > 0) & (F.col("_pos") % rows == 0)).orderBy("x").select("x").collect()]
    own = F.floor(F.col("_pos") / rows).cast("int")
    pieces = knots.select("x", "v", F.explode(F.array_distinct(F.array(own, F.when((F.col("_pos") % rows == 0) & (own > 0), own - 1).otherwise(own)))).alias("_piece"))

    @F.pandas_udf("int")
    def piece(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(float), side="right").astype(np.int32))

    schema = StructType([f for f in df.schema.fields if f.name != out]).add(out, "double")

    def apply(table: pa.Table, knots_: pa.Table) -> pa.Table:
        x = table.column("_x").to_numpy()
        k = knots_.sort_by("x")
        made = np.interp(x, k.column("x").to_numpy(), k.column("v").to_numpy()) if k.num_rows else np.full(len(x), np.nan)
        return with_columns(table.drop_columns(["_x", "_piece"]), {out: made})

    cur = df.drop(out).withColumn("_x", F.col(p).cast("double"))
    there = cur.filter("_x IS NOT NULL").withColumn("_piece", piece("_x"))
    spread = there.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int"))  # rows of a piece in several tasks
    copies = pieces.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    done = spread.groupBy("_piece", "_salt").cogroup(copies.groupBy("_piece", "_salt")).applyInArrow(lambda a, b: apply(a.drop_columns(["_salt"]), b), schema)
    return done.unionByName(cur.filter("_x IS NULL").drop("_x").withColumn(out, F.lit(None).cast("double")))


def live_base_rate(
    df: DataFrame, posterior: str, y: str, h: int, fallback: Column | float, ent: Ent, t: str, window: int = 1260, every: int = 21, min_rows: int = 250, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """base_rate_live: at every 21st row the mean outcome of rows [i-h-window, i-h), held until the next.

    Only rows with posterior and outcome count, at least 250 of them; else the value before,
    else `fallback`. Outcomes of the last h rows aren't known at row i and are never read.
    Windows are differences of running counts in blocks with halo rows; a block takes over the
    last value of those before it.
    """
    usable = F.when(F.col(posterior).isNotNull() & F.col(y).isNotNull(), F.col(y)).cast("double")
    placed = positions(df.withColumn("_u", usable), ent, t)

    def rate(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        known = ~np.isnan(x["_u"])
        running = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        n, total = running(known), running(np.where(known, x["_u"], 0.0))
        i = np.arange(len(known))
        hi, lo = np.maximum(i - h, 0), np.maximum(i - h - window, 0)
        count = n[hi] - n[lo]
        here = (x["_pos"] % every == 0) & (count >= max(min_rows, 1))
        return {"_rate": np.where(here, (total[hi] - total[lo]) / np.maximum(count, 1), np.nan)}

    cur = map_blocks(halo(placed, rows, h + window), ent, ["_u", "_pos"], rate, ["_rate"], keep=["_pos", "_block"])
    w = Window.partitionBy(*ent, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last("_rate", True).over(w)
    if several(placed, rows):
        cur = stage(cur, "rates")
        last = cur.groupBy(*ent, "_block").agg(F.max_by("_rate", F.when(F.col("_rate").isNotNull(), F.col("_pos"))).alias("_last"))
        ahead = Window.partitionBy(*ent).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        before = last.select(F.col("_block").alias("_b"), F.last("_last", True).over(ahead).alias("_entry"), *[F.col(c).alias(f"_e{i}") for i, c in enumerate(ent)])
        cur = cur.join(before, _same(ent, F.col("_block") == F.col("_b")), "left")
        held = F.coalesce(held, F.col("_entry"))
    return cur.withColumn("base_rate_live", F.coalesce(held, number(fallback))).select(*df.columns, "base_rate_live")


def _same(ent: Ent, on: Column) -> Column:
    for i, c in enumerate(ent):
        on &= F.col(c).eqNullSafe(F.col(f"_e{i}"))
    return on


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, intercept) of least log loss plus slope^2 / 2.

    Newton steps on a convex loss, each halved until the loss falls enough; without that they
    run away where x says little about y or where outcomes are rare.
    """
    loss = lambda a, b: np.logaddexp(0.0, a * x + b).sum() - (y * (a * x + b)).sum() + a * a / 2
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    a, b = 0.0, float(np.log(share / (1 - share)))
    now = loss(a, b)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        v = q * (1 - q)
        g = np.array([((q - y) * x).sum() + a, (q - y).sum()])
        step = np.linalg.solve([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]], g)
        size, fall = 1.0, float(g @ step)
        while (new := loss(a - size * step[0], b - size * step[1])) > now - 1e-4 * size * fall and size > 1e-10:
            size /= 2
        if new >= now:
            break
        a, b, now = a - size * step[0], b - size * step[1], new
        if np.abs(size * step).max() < 1e-10:
            break
    return float(a), float(b)


def adaptive_remap(
    df: DataFrame, posterior: str, y: str, h: int, ent: Ent, t: str, window: int = 1260, every: int = 21, min_rows: int = 250, rows: int = 2_100,
) -> DataFrame:
    """Platt map refitted per block of 21 rows on the same lagged window; the posterior itself where it can't be fitted.

    A task refits for `rows` rows (a multiple of `every`), with the h + window rows ahead of
    them, so an entity's refits are spread over many tasks.
    """
    rows = max(every, rows - rows % every)
    both = lambda c: F.col(c).cast("double")
    cur = halo(positions(df.withColumns({"_p": both(posterior), "_y": both(y)}), ent, t), rows, h + window)

    def remap(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p, target, pos = v["_p"], v["_y"], v["_pos"]
        x = np.log(np.clip(p, P_MIN, P_MAX) / (1 - np.clip(p, P_MIN, P_MAX)))
        known, out = ~np.isnan(p) & ~np.isnan(target), p.copy()
        for i in np.flatnonzero((pos % every == 0) & (pos >= pos[-1] // rows * rows)):
            past = slice(max(0, i - h - window), max(0, i - h))
            ok = known[past]
            if ok.sum() >= max(min_rows, 1) and 0 < target[past][ok].mean() < 1:
                a, b = logistic_fit(x[past][ok], target[past][ok])
                out[i : i + every] = 1 / (1 + np.exp(-(a * x[i : i + every] + b)))
        return {"remapped": out}

    return map_blocks(cur, ent, ["_p", "_y", "_pos"], remap, ["remapped"]).select(*df.columns, "remapped")


def reanchor_prior(p: Column, live: Column, train: Column | float) -> Column:
    """Posterior moved from the training base rate to the live one on the log-odds scale."""
    return sigmoid(logit(live) + logit(p) - logit(number(train)))


def confidence(df: DataFrame, engines: Sequence[str], prior: Column | float, support: str | None) -> DataFrame:
    """Geometric mean of agreement, coverage and analog support, each at least 1e-4."""
    values = F.filter(F.array(*[logit(F.col(f"calibrated_{e}")) - logit(number(prior)) for e in engines]), lambda x: x.isNotNull())
    n = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), n)
    std = F.sqrt(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(2.0))), n))
    parts = {"agreement": 1 / (1 + F.coalesce(std, F.lit(0.0)) / 1.5), "coverage": n / len(engines), "support": F.coalesce(F.col(support), F.lit(0.0)) if support else F.lit(0.5)}
    cur = df.withColumns({k: F.greatest(F.lit(1e-4), v.cast("double")) for k, v in parts.items()})
    return cur.withColumn("confidence", F.pow(F.col("agreement") * F.col("coverage") * F.col("support"), 1 / 3))


def composite_z(df: DataFrame, names: Sequence[str], out: str, ent: Ent, t: str, inverted: frozenset = INVERTED, min_values: int = 252) -> DataFrame:
    """Expanding z of each feature (sign turned where low is stressed), row mean, expanding z again.

    Only features with more than 252 values in the whole frame take part.
    """
    there = [c for c in names if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in there]).first() if there else {}
    used = [c for c in there if counts[c] > min_values]
    if not used:
        return df.withColumn(out, F.lit(None).cast("double"))
    cur = df.withColumns({f"_z_{c}": expanding_z(-F.col(c) if c in inverted else F.col(c), ent, t) for c in used})
    z = [F.col(f"_z_{c}") for c in used]
    mean = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in z), F.lit(0.0)), sum((x.isNotNull().cast("int") for x in z), F.lit(0)))
    return cur.withColumn("_mean", mean).withColumn(out, expanding_z("_mean", ent, t)).drop("_mean", *[f"_z_{c}" for c in used])


def archetype_scores(df: DataFrame, ent: Ent, t: str) -> DataFrame:
    for name, features in ARCHETYPES.items():
        df = composite_z(df, features, name, ent, t)
    return df


def layers(df: DataFrame, ent: Ent, t: str, slow: int = 63, fast: int = 10) -> DataFrame:
    """layer1 (largest archetype over 63 rows) and its name, layer2 (tactical composite over 10), layer3 (drawdown)."""
    cur = composite_z(archetype_scores(df, ent, t), TACTICAL, "_tactical", ent, t)
    cur = cur.withColumns({f"_m_{a}": F.max(a).over(last_rows(slow, ent, t)) for a in ARCHETYPES})
    top = F.greatest(*[F.col(f"_m_{a}") for a in ARCHETYPES])
    name = reduce(lambda c, a: c.when(F.col(f"_m_{a}") == top, a), ARCHETYPES, F)
    return cur.withColumns({
        "layer1": top, "archetype": name, "layer2": F.max("_tactical").over(last_rows(fast, ent, t)), "layer3": -F.col("dd_from_252h"),
    }).drop("_tactical", *[f"_m_{a}" for a in ARCHETYPES])


def _checks(cfg: GateConfig) -> list[tuple[str, Column]]:
    post = F.col("posterior")
    enough = (post >= cfg.lift * F.col("base_rate_live")) & (post >= cfg.min_posterior) if cfg.lift is not None else post >= cfg.posterior
    tests = [("post", enough), ("conf", F.col("confidence") >= cfg.confidence), ("L1", F.col("layer1") >= cfg.layer1), ("L2", F.col("layer2") >= cfg.layer2), ("L3", F.col("layer3") >= cfg.layer3)]
    return [(n, F.coalesce(c, F.lit(False))) for n, c in tests]


def gate(df: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """`fires` when every check holds (a null fails)."""
    return df.withColumn("fires", reduce(lambda a, x: a & x[1], _checks(cfg), F.lit(True)))


def gate_reason(df: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """`reason`: OK, or the failed checks joined by " & "."""
    failed = F.concat_ws(" & ", *[F.when(~c, n) for n, c in _checks(cfg)])
    return df.withColumn("reason", F.when(failed == "", "OK").otherwise(failed))


def contributions(df: DataFrame, weights: dict[str, float], prior: float) -> DataFrame:
    return df.withColumns({f"contribution_{e}": float(w) * (logit(F.col(f"calibrated_{e}")) - logit(F.lit(prior))) for e, w in weights.items()})


def tune_gate(df: DataFrame, cfg: GateConfig, base_rate: float) -> GateConfig:
    """Thresholds whose training fire rate is nearest the target from above, else the largest below.

    The same quantile cuts layers 1 and 2; the posterior must exceed lift times the live base
    rate, or an absolute quantile when that rate is constant. Every row meets the whole grid
    once, in one aggregate; the first cell in grid order wins ties, no admissible cell leaves `cfg`.
    """
    at = exact_quantiles(df, ["layer1", "layer2", "posterior"], cfg.quantiles)
    if any(q is None for q in at.values()):
        return cfg
    moving = (df.agg(F.stddev_samp("base_rate_live")).first()[0] or 0.0) > 1e-9
    cells = [
        GateConfig(**{**cfg.__dict__, "layer1": a, "layer2": b, "lift": lift, "posterior": cfg.posterior if lift else max(p, cfg.min_posterior, base_rate), "source": "tuned"})
        for a, b, p in zip(*at.values()) for lift in (cfg.lifts if moving else (None,))
    ]
    fires = lambda c: reduce(lambda a, x: a & x[1], _checks(c), F.lit(True))
    rates = df.agg(*[F.avg(fires(c).cast("double")).alias(f"r{i}") for i, c in enumerate(cells)]).first()
    best = None
    for i, c in enumerate(cells):
        rate = rates[f"r{i}"] or 0.0
        key = (rate >= cfg.target_rate, -rate if rate >= cfg.target_rate else rate)
        if cfg.min_rate <= rate <= cfg.max_rate and (best is None or key > best[0]):
            best = (key, c)
    return best[1] if best else cfg


def audit_table(df: DataFrame, skill: dict[str, float], weights: dict[str, float], cfg: GateConfig) -> DataFrame:
    """One row per engine (skill, weight, mean calibrated probability) with the gate's thresholds and their source."""
    row = F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(float(s)).alias("skill"), F.lit(float(weights[e])).alias("weight"), F.col(f"_{e}").alias("mean_calibrated")) for e, s in skill.items()])
    one = df.agg(*[F.avg(f"calibrated_{e}").alias(f"_{e}") for e in skill])
    return one.select(F.explode(row).alias("x")).select("x.*").withColumns({
        "layer1": F.lit(float(cfg.layer1)), "layer2": F.lit(float(cfg.layer2)), "layer3": F.lit(float(cfg.layer3)), "threshold_source": F.lit(cfg.source),
    })
