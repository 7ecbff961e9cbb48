"""Four scoring jobs: anomaly, regime (hidden Markov), analogs (k nearest) and connectedness."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.functions.blocks import BLOCK_ROWS, halo, map_blocks, positions, several
from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.rolling import rolling, shift
from tidemark.functions.windows import Ent, order, pct_change, so_far, whole
from tidemark.operators.labels import forward_maxdd
from tidemark.sources.staging import stage

# Fixed values of the engines.
HORIZONS = (21, 63, 126, 252)
HMM_FEATURES = ("rv_21_z", "rv_63_z", "dd_from_252h", "vix_z", "hy_spread_z", "yc_10y_3m", "ma200_dist")
ASSETS = {
    "equity": ("pct", ["nasdaq_close", "sp500_close"]), "vol": ("diff", ["vix_close"]), "rates": ("diff", ["yield_10y"]),
    "credit": ("diff", ["baa_10y_spread", "aaa_10y_spread"]), "liquidity": ("diff", ["nfci"]), "oil": ("pct", ["oil_wti"]), "dollar": ("pct", ["dollar_twi"]),
}
MIN_NORMAL, MIN_FEATURES, TREES, TREE_ROWS, ALERT = 500, 5, 200, 256, 0.99
#: Rows of a reference that are sent to every task at most; a larger one is ranked by a sort.
REFERENCE_ROWS = 1_000_000
#: Queries and pool rows that meet in a task, about.
QUERY_ROWS, POOL_ROWS = 30_000, 40_000
#: Pairs that meet in one product.
MEET_PAIRS = 1 << 20
#: Pivots at most; these and a radius and size each are what tasks know of the whole pool.
PIVOTS = 256


class TooLittleData(ValueError):
    """An engine has too few rows, columns or assets to be fitted."""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rank_vs_reference(df: DataFrame, score: str, reference: DataFrame, out: str = "rank") -> DataFrame:
    """Share of the reference's `score` values strictly below each row's; null stays null.

    A reference up to REFERENCE_ROWS rows is a sorted array in every task. A larger one is
    joined by its distinct values: reference counts are summed per value, the values are sorted
    in ranges whose totals give each range its start, and each query takes the sum of the
    values before its own.
    """
    head = reference.select(F.col(score).cast("double")).filter(F.col(score).isNotNull()).limit(REFERENCE_ROWS + 1).toPandas().iloc[:, 0].to_numpy(float)
    n = len(head)
    if n == 0:
        return df.withColumn(out, F.lit(None).cast("double"))
    if n <= REFERENCE_ROWS:
        values = np.sort(head)

        @F.pandas_udf("double")
        def share(x: pd.Series) -> pd.Series:
            return pd.Series(np.where(x.isna(), np.nan, np.searchsorted(values, x.to_numpy(float), side="left") / n)).replace({np.nan: None}).astype("Float64")

        return df.withColumn(out, share(F.col(score).cast("double")))
    n = reference.filter(F.col(score).isNotNull()).count()
    keyed = stage(df.withColumn("_row", F.monotonically_increasing_id()), "ranked")
    ups = reference.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_row", F.lit(None).cast("long"))
    both = keyed.select(F.col(score).cast("double").alias("_v"), F.lit(0).cast("long").alias("_n"), "_row").filter("_v IS NOT NULL").unionByName(ups)
    # one row for each distinct value: the rows before it hold what is strictly below
    parts = stage(both.groupBy("_v").agg(F.sum("_n").alias("_n")).repartitionByRange("_v").withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.groupBy("_part").agg(F.sum("_n").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = parts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(start), "_part")  # one row per range
    ranks = both.filter("_row IS NOT NULL").select("_row", "_v").join(below.select("_v", "_in", "_start"), "_v")
    found = ranks.select("_row", ((F.col("_in") + F.col("_start")) / n).alias(out))
    return keyed.join(found, "_row", "left").drop("_row")


@dataclass(frozen=True)
class Scaler:
    """Kept columns with their medians, means and population deviations."""

    columns: tuple[str, ...]
    median: tuple[float, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]


def fit_imputer_scaler(df: DataFrame, columns: Sequence[str], min_share: float = 0.5) -> Scaler:
    """Columns with at least `min_share` values; medians; mean and deviation after imputing (0 becomes 1)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    kept = [c for c in columns if row["_n"] and row[f"n_{c}"] >= min_share * row["_n"] and row[f"n_{c}"]]
    median = {c: q[0] for c, q in exact_quantiles(df, kept, [0.5]).items()}
    full = [F.coalesce(F.col(c).cast("double"), F.lit(median[c])) for c in kept]
    stats = df.agg(*[e.alias(f"{k}_{c}") for c, x in zip(kept, full) for k, e in (("a", F.avg(x)), ("s", F.stddev_pop(x)))]).first() if kept else {}
    return Scaler(tuple(kept), tuple(median[c] for c in kept), tuple(stats[f"a_{c}"] for c in kept), tuple(stats[f"s_{c}"] or 1.0 for c in kept))


def apply_imputer_scaler(df: DataFrame, scaler: Scaler, prefix: str = "z_") -> DataFrame:
    cells = zip(scaler.columns, scaler.median, scaler.mean, scaler.std)
    return df.withColumns({f"{prefix}{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - a) / s for c, m, a, s in cells})


def ledoit_wolf_cov(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """(means, shrunk covariance, shrinkage): two passes of per-task sums, d x d numbers on the driver."""
    rows, d = df.select(*columns), len(columns)

    def first(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return sum((np.append(m.sum(axis=0), len(m)) for m in (vec.matrix(b, columns) for b in batches)), np.zeros(d + 1))

    sums = vec.vector_sum(rows, first)
    n, mean = int(sums[-1]), sums[:-1] / sums[-1]

    def second(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(d * d + 1)
        for b in batches:
            x = vec.matrix(b, columns) - mean
            total += np.append((x.T @ x).ravel(), ((x**2).sum(axis=1) ** 2).sum())
        return total

    moments = vec.vector_sum(rows, second)
    cov, shrink = vec.ledoit_wolf(n, moments[:-1].reshape(d, d), moments[-1])
    return mean, cov, shrink


def mahalanobis_score(df: DataFrame, columns: Sequence[str], mean: np.ndarray, cov: np.ndarray, out: str = "mahalanobis") -> DataFrame:
    """Squared Mahalanobis distance to `mean`."""
    precision = np.linalg.inv(cov)

    @F.pandas_udf("double")
    def score(*x: pd.Series) -> pd.Series:
        z = np.column_stack([s.to_numpy(float) for s in x]) - mean
        return pd.Series(np.einsum("ij,jk,ik->i", z, precision, z))

    return df.withColumn(out, score(*[F.col(c) for c in columns]))


def isolation_forest(df: DataFrame, columns: Sequence[str], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42) -> tuple[list, int]:
    """(trees, rows of a tree's sample). Each tree takes the `rows` rows with its smallest hashes and grows in a task.

    A task keeps `rows` rows per tree while its rows pass by, so what it sends doesn't grow with
    its input; the samples of tasks merge by hash. Equal rows are told apart by their number in
    a batch; the draw of distinct rows depends on the rows alone.
    """
    n = df.count()
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    salt = mix64(np.arange(trees, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros((0, len(columns))))] * trees
        for batch in batches:
            x = vec.matrix(batch, columns)
            names = np.frombuffer(b"".join(hashlib.blake2b(r.tobytes(), digest_size=8).digest() for r in x), np.uint64)
            by_row = mix64(names + pd.Series(names).groupby(names).cumcount().to_numpy().astype(np.uint64))
            for i in range(trees):
                h = mix64(by_row ^ salt[i])
                if len(held[i][0]) == rows:
                    low = h < held[i][0].max()
                    h, part = h[low], x[low]
                else:
                    part = x
                both = np.concatenate([held[i][0], h]), np.concatenate([held[i][1], part])
                take = np.argpartition(both[0], rows - 1)[:rows] if len(both[0]) > rows else np.arange(len(both[0]))
                held[i] = both[0][take], both[1][take]
        for i, (h, x) in enumerate(held):
            if len(h):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i), pa.int32()), pa.array(h.view(np.int64)), flat], names=["_t", "_h", "_x"])

    drawn = cells.mapInArrow(smallest, "_t int, _h bigint, _x array<double>")
    depth = math.ceil(math.log2(max(2, min(rows, n))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_t"].iloc[0])
        order_ = np.argsort(pdf["_h"].to_numpy().view(np.uint64), kind="stable")[:rows]
        x = np.array(pdf["_x"].iloc[order_].to_list(), float)
        nodes = vec.grow_tree(x, np.random.default_rng([seed, t]), depth)
        return pd.DataFrame({"_t": t, "node": range(len(nodes)), "f": [k[0] for k in nodes], "cut": [k[1] for k in nodes], "l": [k[2] for k in nodes], "r": [k[3] for k in nodes]})

    found = drawn.groupBy("_t").applyInPandas(grow, "_t int, node int, f int, cut double, l int, r int").orderBy("_t", "node").collect()
    forest: dict[int, list] = {}
    for r in found:  # trees x 2 x rows nodes at most
        forest.setdefault(r["_t"], []).append((r["f"], r["cut"], r["l"], r["r"]))
    return list(forest.values()), min(rows, n)


def isolation_forest_score(df: DataFrame, columns: Sequence[str], forest: list, rows: int, out: str = "isolation") -> DataFrame:
    """2^(-mean path / expected path); higher is more isolated."""
    norm = vec.average_path(rows) or 1.0

    @F.pandas_udf("double")
    def score(*x: pd.Series) -> pd.Series:
        return pd.Series(2.0 ** (-vec.path_lengths(forest, np.column_stack([s.to_numpy(float) for s in x])) / norm))

    return df.withColumn(out, score(*[F.col(c).cast("double") for c in columns]))


def anomaly_ensemble(df: DataFrame, a: str = "mahalanobis_rank", b: str = "isolation_rank") -> DataFrame:
    """Mean rank, agreement and alert of two ranks."""
    mean = (F.col(a) + F.col(b)) / 2
    return df.withColumns({"ensemble_rank": mean, "ensemble_confidence": 1 - F.abs(F.col(a) - F.col(b)), "anomaly_alert": mean >= ALERT})


@dataclass(frozen=True)
class Anomaly:
    scaler: Scaler
    mean: np.ndarray
    cov: np.ndarray
    forest: list
    rows: int
    reference: DataFrame = field(repr=False)


def anomaly_fit(normal: DataFrame, columns: Sequence[str], min_normal: int = MIN_NORMAL) -> Anomaly:
    """Model of normal rows; needs `min_normal` of them and 5 usable columns."""
    scaler = fit_imputer_scaler(normal, columns)
    if normal.count() < min_normal or len(scaler.columns) < MIN_FEATURES:
        raise TooLittleData("too few normal rows or features")
    z = apply_imputer_scaler(normal, scaler)
    names = [f"z_{c}" for c in scaler.columns]
    mean, cov, _ = ledoit_wolf_cov(z, names)
    forest, rows = isolation_forest(z, names)
    scored = isolation_forest_score(mahalanobis_score(z, names, mean, cov), names, forest, rows)
    return Anomaly(scaler, mean, cov, forest, rows, scored.select("mahalanobis", "isolation"))


def anomaly_score(df: DataFrame, model: Anomaly) -> DataFrame:
    z = apply_imputer_scaler(df, model.scaler)
    names = [f"z_{c}" for c in model.scaler.columns]
    scored = isolation_forest_score(mahalanobis_score(z, names, model.mean, model.cov), names, model.forest, model.rows)
    for s in ("mahalanobis", "isolation"):
        scored = rank_vs_reference(scored, s, model.reference, f"{s}_rank")
    return anomaly_ensemble(scored).drop(*names)


@dataclass(frozen=True)
class Hmm:
    scaler: Scaler
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = float("nan")


def _messages(cur: DataFrame, names: Sequence[str], ent: Ent, model: tuple) -> DataFrame:
    """(ent, _block, entry, exit): what each block of a long entity meets at its ends.

    A block is one K x K matrix, the product of its rows' steps. An entity's matrices are
    multiplied up in block order: from the left to the filtered posterior before a block (null
    for the first), from the right to the likelihood of all that follows it.
    """
    start, trans, means, covs = model
    kinds = dict(cur.dtypes)
    keys = "".join(f"`{c}` {kinds[c]}, " for c in ent)

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        m = vec.hmm_transfer(vec.log_gauss(pdf[names].to_numpy(float), means, covs), trans, pdf["_pos"].iloc[0] == 0)
        return pdf[[*ent, "_block"]].iloc[:1].assign(m=[m.ravel()])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        mats = np.stack(pdf["m"].to_list()).reshape(len(pdf), len(start), len(start))
        left, right = [], [np.ones(len(start))]
        state = start
        for m in mats:
            left.append(state)
            state = state @ m / (state @ m).sum()
        for m in mats[:0:-1]:
            right.append(m @ right[-1] / (m @ right[-1]).max())
        return pdf[[*ent, "_block"]].assign(entry=[None, *left[1:]], exit=right[::-1])

    blocks_ = cur.groupBy(*ent, "_block").applyInPandas(transfer, f"{keys}_block long, m array<double>")
    return blocks_.groupBy(*ent).applyInPandas(compose, f"{keys}_block long, entry array<double>, exit array<double>")


def _with_messages(cur: DataFrame, messages: DataFrame | None, ent: Ent, run, schema: str) -> DataFrame:
    """`run(rows in order, entry or None, exit or None)` per block."""
    if messages is None:
        return cur.groupBy(*ent, "_block").applyInPandas(lambda pdf: run(pdf.sort_values("_pos"), None, None), schema)

    def both(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        entry, exit_ = (None if v is None else np.asarray(v, float) for v in ends[["entry", "exit"]].iloc[0])
        return run(pdf.sort_values("_pos"), entry, exit_)

    return cur.groupBy(*ent, "_block").cogroup(messages.groupBy(*ent, "_block")).applyInPandas(both, schema)


def hmm_fit(
    df: DataFrame, columns: Sequence[str], ent: Ent, t: str, n_states: int = 4, rounds: int = 100, tol: float = 1e-2, ridge: float = 1e-3, rows: int = BLOCK_ROWS,
) -> Hmm:
    """Gaussian HMM by EM. Entities are sequences of their own, in blocks of `rows` rows that are tasks
    of their own; what a block needs of the others are two vectors, and only sums of K x d x d
    numbers are added up. Starts from quantiles of the first column."""
    scaler = fit_imputer_scaler(df, columns)
    if len(scaler.columns) < min(3, len(columns)):
        raise TooLittleData("too few usable columns")
    names, d, k = [f"z_{c}" for c in scaler.columns], len(scaler.columns), n_states
    placed = positions(apply_imputer_scaler(df, scaler).select(*ent, t, *names), ent, t)
    z = halo(placed, rows, 0).repartition(*[F.col(c) for c in (*ent, "_block")]).persist()  # one shuffle for all rounds
    long = several(z, rows)
    cuts = exact_quantiles(z, names[:1], [i / k for i in range(1, k)])[names[0]]
    state = reduce(lambda c, x: c + (F.col(names[0]) > x).cast("int"), cuts, F.lit(0))
    groups = {r["_k"]: r for r in z.withColumn("_k", state).groupBy("_k").agg(*[F.avg(c).alias(c) for c in names]).collect()}
    means = np.array([[groups[i][c] if i in groups else 0.0 for c in names] for i in range(k)])
    covs, start, trans = np.tile(np.eye(d), (k, 1, 1)), np.full(k, 1 / k), np.full((k, k), 0.05 / max(k - 1, 1)) + np.eye(k) * (0.95 - 0.05 / max(k - 1, 1))
    last = -np.inf
    size = k + k * k + k + k * d + k * d * d + 1
    for _ in range(rounds):
        s0, a0, m0, c0 = start, trans, means, covs

        def expect(pdf: pd.DataFrame, entry: np.ndarray | None, exit_: np.ndarray | None) -> pd.DataFrame:
            x = pdf[names].to_numpy(float)
            post, moves, ll = vec.hmm_expect(vec.log_gauss(x, m0, c0), s0, a0, entry, exit_)
            head = post[0] if pdf["_pos"].iloc[0] == 0 else np.zeros(k)
            flat = np.concatenate([head, moves.ravel(), post.sum(axis=0), (post.T @ x).ravel(), np.einsum("tk,ti,tj->kij", post, x, x).ravel(), [ll]])
            return pd.DataFrame({"i": np.arange(size), "v": flat})

        messages = _messages(z, names, ent, (s0, a0, m0, c0)) if long else None
        sums = _with_messages(z, messages, ent, expect, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        v = np.array([r["v"] for r in sums])
        p0, moves, n, sx, sxx, ll = np.split(v, np.cumsum([k, k * k, k, k * d, k * d * d]))
        n, moves = np.maximum(n, 1e-9), moves.reshape(k, k) + 1e-9
        start, trans, means = (p0 + 1e-9) / (p0 + 1e-9).sum(), moves / moves.sum(axis=1, keepdims=True), sx.reshape(k, d) / n[:, None]
        covs = sxx.reshape(k, d, d) / n[:, None, None] - np.einsum("ki,kj->kij", means, means) + ridge * np.eye(d)
        if ll[0] - last < tol:
            break
        last = ll[0]
    z.unpersist()
    return Hmm(scaler, start, trans, means, covs, float(ll[0]))


def hmm_states(model: Hmm, by: str = "rv_21_z") -> dict[str, list[int]]:
    """calm: state with the lowest mean of `by` (else the first column); crisis: the highest; stress: upper half."""
    at = model.scaler.columns.index(by) if by in model.scaler.columns else 0
    ranked = [int(i) for i in np.argsort(model.means[:, at])]
    return {"calm": ranked[:1], "crisis": ranked[-1:], "stress": ranked[len(ranked) // 2 :]}


def hmm_filter(df: DataFrame, model: Hmm, ent: Ent, t: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Filtered posteriors p_0..p_{K-1} per row; a row's posterior uses no later row. Blocks of `rows` rows are tasks of their own."""
    names, k = [f"z_{c}" for c in model.scaler.columns], len(model.start)
    placed = positions(apply_imputer_scaler(df, model.scaler).select(*ent, t, *names), ent, t)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*ent, t)), *(f"p_{i} double" for i in range(k))])

    def run(pdf: pd.DataFrame, entry: np.ndarray | None, exit_: np.ndarray | None) -> pd.DataFrame:
        post = vec.hmm_forward(vec.log_gauss(pdf[names].to_numpy(float), model.means, model.covs), model.start, model.trans, entry)
        return pd.concat([pdf[[*ent, t]].reset_index(drop=True), pd.DataFrame(post, columns=[f"p_{i}" for i in range(k)])], axis=1)

    z = halo(placed, rows, 0)
    messages = _messages(z, names, ent, (model.start, model.trans, model.means, model.covs)) if several(placed, rows) else None
    return _with_messages(z, messages, ent, run, schema)


def hmm_horizon(post: DataFrame, model: Hmm, h: int = 21) -> DataFrame:
    """Hard state, stress score, and crisis and stress probability h rows ahead."""
    k, roles = len(model.start), hmm_states(model)
    step = np.linalg.matrix_power(model.trans, h)
    p = [F.col(f"p_{i}") for i in range(k)]
    total = lambda w: sum((p[i] * float(w[i]) for i in range(k)), F.lit(0.0))
    top = F.greatest(*p)
    return post.withColumns({
        "state": reduce(lambda c, i: c.when(p[i] == top, i), range(k), F), "stress_score": sum((p[i] for i in roles["stress"]), F.lit(0.0)),
        "h_step_crisis_prob": total(step[:, roles["crisis"]].sum(axis=1)), "h_step_stress_prob": total(step[:, roles["stress"]].sum(axis=1)),
    })


def analog_pool(df: DataFrame, px: str, ent: Ent, t: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows whose drawdown is known at the longest horizon, with the drawdown at each."""
    for h in horizons:
        df = forward_maxdd(df, px, h, ent, t, f"dd_{h}")
    return df.filter(F.col(f"dd_{max(horizons)}").isNotNull())


def analog_whiten(df: DataFrame, columns: Sequence[str], mean: np.ndarray, cov: np.ndarray, out: str = "w") -> DataFrame:
    """Array column in which Euclidean distance is Mahalanobis distance."""
    try:
        w = np.linalg.cholesky(np.linalg.inv(cov))
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(cov)
        w = vectors / np.sqrt(np.maximum(values, 1e-12))

    @F.pandas_udf("array<double>")
    def white(*x: pd.Series) -> pd.Series:
        return pd.Series(list((np.column_stack([s.to_numpy(float) for s in x]) - mean) @ w))

    return df.withColumn(out, white(*[F.col(c).cast("double") for c in columns]))


def _matrix(t: pa.Table) -> np.ndarray:
    """The rows' vectors `_w`; a null entry is NaN."""
    return np.asarray(pc.list_flatten(t.column("_w")).to_numpy(), float).reshape(t.num_rows, -1) + 0.0 if t.num_rows else np.zeros((0, 1))


def _halves(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(l, r, scale): l @ r.T is at most the squared distance over scale^2 of each row of q and x, and short of it by little more than float32 rounds."""
    whole_q, whole_x = np.isfinite(q).all(axis=1), np.isfinite(x).all(axis=1)
    mid = x[whole_x].mean(axis=0) if whole_x.any() else np.zeros(x.shape[1])  # products lose fewer digits around the middle
    a, b = q - mid, x - mid
    scale = max(np.abs(a[whole_q]).max(initial=0), np.abs(b[whole_x]).max(initial=0)) or 1.0
    a, b = a / scale, b / scale
    less = 1 - (2 * a.shape[1] + 16) * 2.0**-24  # rounding takes a share of |a|^2 + |b|^2
    square = lambda v: (v**2).sum(axis=1) * less
    return np.column_stack([-2 * a, square(a), np.ones(len(a))]).astype(np.float32), np.column_stack([b, np.ones(len(b)), square(b)]).astype(np.float32), float(scale)


def _pieces(cell: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of rows sorted by cell: each in one cell, short ones first, as the limits are wide then."""
    most = 256
    for start, end in zip(edges := np.flatnonzero(np.diff(cell, prepend=-1)).tolist(), [*edges[1:], len(cell)]):
        while start < end:
            yield start, min(end, start + most)
            start, most = start + most, min(2 * most, 4_096)


def _cell(k: int, embargo_days: int | None, kept: Sequence[str], cells: Cells | None = None):
    """The k best rows of a part of the pool (_p, _d, _w, kept) for each query of a block (_q, _d, _w).

    With `cells`, pool rows have their `_cell` and queries `_tau`, which their k best don't exceed
    (null: unknown). A query meets a cell only if a row there can be nearer than its limit, the
    lesser of `_tau` and its k-th best so far. Of the pairs that meet, a product in float32 rules
    out those that are over the limit for certain; the others' distances are taken in double.
    """

    def run(queries: pa.Table, pool: pa.Table) -> pa.Table:
        names = ["_q", "distance", "_p", *kept]
        if cells is not None:
            pool = pool.take(pc.sort_indices(pool, [("_cell", "ascending")]))
        q, x = _matrix(queries), _matrix(pool)
        if not (len(q) and len(x)):
            return pa.table([t.column(c).slice(0, 0) if c != "distance" else pa.array([], pa.float64()) for c, t in zip(names, [queries, pool, *[pool] * len(names)])], names=names)
        qd, pd_ = (t.column("_d").to_numpy() for t in (queries, pool))
        both = np.ascontiguousarray(np.concatenate([q, x]))
        same = np.unique(both.view([("", f"V{both.itemsize * both.shape[1]}")]).ravel(), return_inverse=True)[1]
        same_q, same_x = same[: len(q)], same[len(q) :]
        exact = lambda i, j: np.concatenate([np.sqrt(((q[i[c : c + 50_000]] - x[j[c : c + 50_000]]) ** 2).sum(axis=1)) for c in range(0, max(1, len(i)), 50_000)])
        left, right, scale = _halves(q, x)
        cell = pool.column("_cell").to_numpy() if cells is not None else np.zeros(len(x), int)
        limit = np.full(len(q), np.inf)
        if cells is not None:
            held = np.unique(cell)
            low = cells.bounds(q, held)[1]
            tau = queries.column("_tau").to_numpy()
            limit = np.where(np.isnan(tau), np.inf, tau) ** 2
        best, at = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        squares, near = np.empty(MEET_PAIRS, np.float32), np.empty(MEET_PAIRS, bool)
        for start, end in _pieces(cell):
            who = np.arange(len(q)) if cells is None else np.flatnonzero(low[:, np.searchsorted(held, cell[start])] ** 2 <= limit)
            step = MEET_PAIRS // (end - start)
            for rows in (who[c : c + step] for c in range(0, len(who), step)):
                shape, n = (len(rows), end - start), len(rows) * (end - start)
                least = np.matmul(left[rows], right[start:end].T, out=squares[:n].reshape(shape))
                upto = (limit[rows] / scale**2 * (1 + 1e-6) + 1e-30).astype(np.float32)[:, None]
                i, j = np.divmod(np.flatnonzero(np.less_equal(least, upto, out=near[:n].reshape(shape))), end - start)
                i_, j_ = rows[i], start + j
                good = same_q[i_] != same_x[j_]  # equal rows are no neighbours
                if embargo_days is not None:
                    good &= np.abs(qd[i_] - pd_[j_]) > embargo_days
                i, j = i[good], j[good]
                far = exact(rows[i], start + j) ** 2
                good = (far > 1e-16) & (far <= limit[rows[i]] * (1 + 1e-12))
                i, j, far = i[good], j[good], far[good]
                if not len(i):
                    continue
                hit, first, n = np.unique(i, return_index=True, return_counts=True)
                wide = np.full((len(hit), k + n.max()), np.inf)
                wide_at = np.full(wide.shape, -1)
                spot = np.repeat(np.arange(len(hit)), n), k + np.arange(len(i)) - np.repeat(first, n)
                mine = rows[hit]
                wide[:, :k], wide_at[:, :k], wide[spot], wide_at[spot] = best[mine], at[mine], far, start + j
                top = np.argpartition(wide, k - 1, axis=1)[:, :k]
                best[mine], at[mine] = np.take_along_axis(wide, top, axis=1), np.take_along_axis(wide_at, top, axis=1)
                limit[mine] = np.minimum(limit[mine], best[mine].max(axis=1))
        i, at_k = np.nonzero(np.isfinite(best))
        j = at[i, at_k]
        return pa.table([queries.column("_q").take(pa.array(i)), pa.array(exact(i, j)), *[pool.column(c).take(pa.array(j)) for c in names[2:]]], names=names)

    return run


def _best(qs: DataFrame, ps: DataFrame, by: Sequence[str], k: int, embargo_days: int | None, kept: Sequence[str], cells: Cells | None = None) -> DataFrame:
    """(_q, distance, _p, kept): queries and pool rows that share `by` meet in a task, which keeps k per query."""
    kinds = dict(ps.dtypes)
    schema = ", ".join([f"_q {dict(qs.dtypes)['_q']}", "distance double", "_p bigint", *(f"{c} {kinds[c]}" for c in kept)])
    return qs.groupBy(*by).cogroup(ps.groupBy(*by)).applyInArrow(_cell(k, embargo_days, kept, cells), schema)


@dataclass(frozen=True)
class Cells:
    """The pool in cells around pivots: each row lies with its nearest pivot. `radius` and `size` are per cell."""

    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def bounds(self, q: np.ndarray, of: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(distance to each pivot, least possible distance to a row of its cell) of each query, for the cells `of`."""
        mid = self.pivots.mean(axis=0)
        q, pivots = q - mid, self.pivots[of] - mid
        d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * q @ pivots.T, 0))
        return d, np.maximum(d - self.radius[of][None] - 1e-6 * (1 + d), 0)  # the product form's rounding stays below this

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """(first part, number of parts) of each cell: small cells share a part of about POOL_ROWS rows, large ones have several."""
        first, n, last, room = [], np.maximum(-(-self.size // POOL_ROWS), 1), -1, 0
        for size, several_ in zip(self.size.tolist(), n.tolist()):
            if several_ > 1 or size > room:
                last, room = last + 1, POOL_ROWS
            first.append(last)
            last, room = last + several_ - 1, room - size if several_ == 1 else 0
        return np.array(first), n


def pivot_cells(ps: DataFrame) -> tuple[Cells, DataFrame]:
    """Cells of pool rows (_p, _w), and the rows with their `_cell`. At most PIVOTS pivots, the rows with the smallest hashes of about the pool's square root."""
    n = ps.count()
    drawn = ps.select(F.xxhash64("_p").alias("h"), "_p", "_w").orderBy("h", "_p").limit(max(1, min(PIVOTS, math.isqrt(n)))).toPandas()["_w"]
    pivots = np.unique(np.array(drawn.to_list(), float), axis=0) if len(drawn) else np.zeros((1, 1))
    whole_ = np.isfinite(pivots).all(axis=1)
    pivots = pivots[whole_] if whole_.any() else np.zeros((1, pivots.shape[1]))

    @F.pandas_udf("struct<cell: int, far: double>")
    def nearest_pivot(w: pd.Series) -> pd.DataFrame:
        x = np.array(w.to_list(), float).reshape(len(w), -1)
        d = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
        at = d.argmin(axis=1)
        return pd.DataFrame({"cell": at.astype(np.int32), "far": np.sqrt(((x - pivots[at]) ** 2).sum(axis=1))})

    rows = stage(ps.withColumn("_at", nearest_pivot("_w")).withColumns({"_cell": F.col("_at.cell"), "_far": F.col("_at.far")}).drop("_at"), "cells")
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in rows.groupBy("_cell").agg(F.max(F.nanvl("_far", F.lit(0.0))).alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row per pivot
        radius[r["_cell"]], size[r["_cell"]] = r["r"], r["n"]
    return Cells(pivots, radius, size), rows.drop("_far")


def nearest(
    queries: DataFrame, pool: DataFrame, k: int, embargo_days: int | None, qid: str, t: str | None, vector: str = "w", keep: Sequence[str] = (), within: Sequence[str] = (),
) -> DataFrame:
    """(qid, pool columns, distance, rank): the k nearest pool rows of every query, exactly.

    The pool lies in cells around pivots; by the triangle inequality a cell whose rows can't be
    nearer than a query's k-th best from its first cells is not visited. Queries in blocks of
    about QUERY_ROWS and parts of about POOL_ROWS pool rows, whole cells or pieces of one, meet
    in tasks; each keeps k rows per query, and these meet by query. A pool row within `embargo_days` calendar days (inclusive)
    of the query, or at distance 0 (the query itself, and copies of it), is no neighbour. With
    `within` (columns without nulls), only rows equal in them meet, and each such group has as
    many cells as its own size asks for.
    """
    days = F.unix_date(F.col(t).cast("date")) if t else F.lit(0)
    kept, same = [f"k_{c}" for c in keep], [f"g_{c}" for c in within]
    own = lambda c, n: F.pmod(F.xxhash64(c), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1).cast("array<bigint>"))
    shared = [days.alias("_d"), F.col(vector).alias("_w"), *[F.col(c).alias(g) for c, g in zip(within, same)]]
    named = [F.col(c).alias(f"k_{c}") for c in keep]
    if within:
        cells = lambda df, n, name: df.groupBy(*within).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
        both = cells(queries, QUERY_ROWS, "_blocks").join(cells(pool, POOL_ROWS, "_parts"), list(within))
        queries, pool = queries.join(both, list(within)), pool.join(both, list(within))
        qs = queries.select(F.col(qid).alias("_q"), own(qid, F.col("_blocks")).alias("_b"), every(F.col("_parts")).alias("_c"), *shared)
        ps = pool.select(F.xxhash64(*keep).alias("_p"), F.col("_blocks"), F.col("_parts"), *shared, *named)
        ps = ps.withColumn("_c", own("_p", F.col("_parts"))).withColumn("_b", every(F.col("_blocks"))).drop("_blocks", "_parts")
        best = _best(qs, ps, [*same, "_b", "_c"], k, embargo_days, kept)
    else:
        best = _indexed(queries.select(F.col(qid).alias("_q"), *shared), pool.select(F.xxhash64(*keep).alias("_p"), *shared, *named), k, embargo_days, kept)[0]
    w = Window.partitionBy("_q").orderBy("distance", "_p")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("_q").alias(qid), *[F.col(f"k_{c}").alias(f"pool_{c}" if c == qid else c) for c in keep], "distance", "rank")


def _indexed(qs: DataFrame, ps: DataFrame, k: int, embargo_days: int | None, kept: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(k best rows per query and part of the pool that it visits, (_q, _rows) with the pool rows met in both passes).

    First each query meets the nearest pivots' cells until these hold four times k rows: its
    k-th best there bounds the k-th best of all. Then blocks of queries meet the parts that
    hold a cell within that bound; a query is sent to a part once, however many cells of it
    it needs.
    """
    qs = stage(qs, "queries")
    cells, rows = pivot_cells(ps)
    first_part, n_parts = cells.parts()
    member = np.zeros((len(n_parts), first_part[-1] + n_parts[-1]), np.float32)
    for c, (f, n) in enumerate(zip(first_part, n_parts)):
        member[c, f : f + n] = 1
    own = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    of_cell = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("_cell") + 1)
    rows = rows.withColumn("_piece", own("_p", of_cell(n_parts))).withColumn("_part", of_cell(first_part) + F.col("_piece"))
    matrix = lambda w: np.array(w.to_list(), float).reshape(len(w), -1)

    @F.pandas_udf("array<int>")
    def near(w: pd.Series) -> pd.Series:
        order_ = cells.bounds(matrix(w))[0].argsort(axis=1, kind="stable")
        upto = (np.cumsum(cells.size[order_], axis=1) < 4 * k).sum(axis=1) + 1
        return pd.Series([o[:u].astype(np.int32) for o, u in zip(order_, upto)])

    @F.pandas_udf("struct<parts: array<int>, rows: bigint>")
    def within_reach(w: pd.Series, tau: pd.Series) -> pd.DataFrame:
        need = (cells.bounds(matrix(w))[1] <= tau.fillna(np.inf).to_numpy(float)[:, None]) & (cells.size > 0)
        return pd.DataFrame({"parts": [np.flatnonzero(p).astype(np.int32) for p in need.astype(np.float32) @ member], "rows": need @ cells.size})

    def meet(visits: DataFrame, there: DataFrame, by: list[str], kept: Sequence[str], cells: Cells | None = None) -> DataFrame:
        blocks_ = visits.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("_blocks"))
        blocks_ = F.broadcast(stage(blocks_, "blocks"))  # a row per part or piece of a cell
        at = visits.join(blocks_, by).withColumn("_b", own("_q", F.col("_blocks"))).drop("_blocks")
        there = there.join(blocks_, by).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        return _best(at, there, [*by, "_b"], k, embargo_days, kept, cells)

    first = stage(qs.withColumn("_cell", F.explode(near("_w"))).withColumn("_piece", F.explode(F.sequence(F.lit(0), of_cell(n_parts) - 1))), "first-visits")
    found = meet(first, rows.drop("_part", *kept), ["_cell", "_piece"], [])
    w = Window.partitionBy("_q").orderBy("distance")
    tau = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k).select("_q", F.col("distance").alias("_tau"))
    asked = stage(qs.join(tau, "_q", "left").withColumn("_reach", within_reach("_w", "_tau")), "reach")
    best = meet(asked.withColumn("_part", F.explode("_reach.parts")).drop("_reach"), rows.drop("_piece"), ["_part"], kept, cells)
    seen = first.filter("_piece = 0").select("_q", of_cell(cells.size).cast("bigint").alias("_rows"))
    return best, seen.unionByName(asked.select("_q", F.col("_reach.rows").alias("_rows")))


def skipped_share(queries: DataFrame, pool: DataFrame, k: int, embargo_days: int | None, qid: str, t: str | None, vector: str = "w", keep: Sequence[str] = ()) -> float:
    """Share of all query-pool distances that `nearest` doesn't compute. The first cells count twice: they are met again with the others."""
    days = F.unix_date(F.col(t).cast("date")) if t else F.lit(0)
    shared = [days.alias("_d"), F.col(vector).alias("_w")]
    ps = pool.select(F.xxhash64(*keep).alias("_p"), *shared)
    seen = _indexed(queries.select(F.col(qid).alias("_q"), *shared), ps, k, embargo_days, [])[1]
    return 1 - (seen.agg(F.sum("_rows").alias("n")).first()["n"] or 0) / max(1, queries.count() * pool.count())


def analog_reference_radii(pool: DataFrame, k: int, qid: str, t: str | None, keep: Sequence[str], longest: int = max(HORIZONS)) -> DataFrame:
    """(radius): distance to the k-th neighbour of every pool row, with the longest horizon's embargo."""
    found = nearest(pool, pool, k, math.ceil(1.6 * longest) if t else None, qid, t, keep=keep)
    return found.groupBy(qid).agg(F.max("distance").alias("radius"), F.max("rank").alias("_n")).filter(F.col("_n") == k).select("radius")


def analog_knn(queries: DataFrame, pool: DataFrame, dd: str, x_pct: float, h: int, k: int, qid: str, t: str | None, radii: DataFrame | None = None) -> DataFrame:
    """(qid, prob, n_neighbours, radius, confidence): share of the k nearest with drawdown of x or more.

    When fewer than k remain outside the embargo, the share is over those that remain.
    """
    found = nearest(queries, pool, k, math.ceil(1.6 * h) if t else None, qid, t, keep=[qid, dd])
    return _analog_summary(found, dd, x_pct, qid, radii)


def _analog_summary(found: DataFrame, dd: str, x_pct: float, qid: str, radii: DataFrame | None) -> DataFrame:
    out = found.groupBy(qid).agg(F.avg((F.col(dd) >= x_pct).cast("double")).alias("prob"), F.count(F.lit(1)).alias("n_neighbours"), F.max("distance").alias("radius"))
    if radii is None:
        return out.withColumn("confidence", F.lit(None).cast("double"))
    ranked = rank_vs_reference(out, "radius", radii, "_rank")
    return ranked.withColumn("confidence", 1 - F.col("_rank")).drop("_rank")


def analog_top_n(queries: DataFrame, pool: DataFrame, qid: str, t: str | None, h: int, keep: Sequence[str], n: int = 10) -> DataFrame:
    """The n nearest pool rows of each query with distance and outcome columns."""
    return nearest(queries, pool, n, math.ceil(1.6 * h) if t else None, qid, t, keep=keep)


def chosen_assets(df: DataFrame, assets: dict = ASSETS, min_obs: int = 252) -> dict:
    """Of each asset the first column with enough values in `df`; TooLittleData for under three assets."""
    there = sorted({c for _, cols in assets.values() for c in cols if c in df.columns})
    counts = df.agg(*[F.count(c).alias(c) for c in there]).first() if there else {}
    chosen = {a: (how, next((c for c in cols if c in there and counts[c] >= min_obs), None)) for a, (how, cols) in assets.items()}
    chosen = {a: (how, [c]) for a, (how, c) in chosen.items() if c}
    if len(chosen) < 3:
        raise TooLittleData("fewer than three assets")
    return chosen


def asset_changes(df: DataFrame, ent: Ent, t: str, assets: dict = ASSETS, min_obs: int = 252) -> DataFrame:
    """(ent, t, one change per asset): of each asset the first column with enough values; rows with a null go."""
    chosen = {a: (how, cols[0]) for a, (how, cols) in chosen_assets(df, assets, min_obs).items()}
    return df.select(*ent, t, *[(pct_change(c, 1, ent, t) if how == "pct" else F.col(c) - F.lag(c).over(order(ent, t))).alias(a) for a, (how, c) in chosen.items()]).dropna(subset=list(chosen))


def pairs_of(assets: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(assets) for b in assets[i + 1 :]]


def rolling_corr_matrix(df: DataFrame, assets: Sequence[str], ent: Ent, t: str, n: int = 252) -> DataFrame:
    """c_<a>_<b> over the n rows before each; this row isn't in it. Null until n rows precede, or without variation.

    Sums over a window are differences of running sums of the entity's centred values, so a
    row costs the same for any n. Rows with a null in any asset are left out of the sums.
    """
    w, past = order(ent, t), so_far(ent, t)
    there = reduce(lambda c, a: c & F.col(a).isNotNull(), assets, F.lit(True))
    cur = df.withColumns({f"_x_{a}": F.when(there, F.col(a) - F.avg(a).over(whole(ent))).otherwise(0.0) for a in assets} | {"_one": there.cast("int")})
    sums = {"_one": F.col("_one")} | {f"_x_{a}": F.col(f"_x_{a}") for a in assets}
    sums |= {f"_p_{a}_{b}": F.col(f"_x_{a}") * F.col(f"_x_{b}") for i, a in enumerate(assets) for b in assets[i:]}
    run = cur.withColumns({f"_s{c}": F.sum(e).over(past) for c, e in sums.items()} | {"_row": F.row_number().over(w)})
    held = run.withColumns({f"_w{c}": F.lag(f"_s{c}", 1).over(w) - F.coalesce(F.lag(f"_s{c}", n + 1).over(w), F.lit(0)) for c in sums})
    part = lambda a, b: F.col(f"_w_p_{a}_{b}") - F.try_divide(F.col(f"_w_x_{a}") * F.col(f"_w_x_{b}"), F.col("_w_one"))
    corr = {f"c_{a}_{b}": F.when(F.col("_row") > n, F.try_divide(part(a, b), F.sqrt(part(a, a) * part(b, b)))) for a, b in pairs_of(assets)}
    return held.select(*df.columns, *[e.alias(c) for c, e in corr.items()])


def connectedness(df: DataFrame, assets: Sequence[str], out: str = "connectedness") -> DataFrame:
    """Share of the largest eigenvalue of the matrix of absolute correlations."""
    d, ij = len(assets), [(i, j) for i in range(len(assets)) for j in range(i + 1, len(assets))]

    @F.pandas_udf("double")
    def share(*x: pd.Series) -> pd.Series:
        m = np.tile(np.eye(d), (len(x[0]), 1, 1))
        for (i, j), s in zip(ij, x):
            m[:, i, j] = m[:, j, i] = np.abs(s.to_numpy(float))
        ok = ~np.isnan(m).any(axis=(1, 2))
        values = np.full(len(m), np.nan)
        if ok.any():
            e = np.linalg.eigvalsh(m[ok])
            values[ok] = e[:, -1] / e.sum(axis=1)
        return pd.Series(values).astype("Float64").where(ok, None)

    return df.withColumn(out, share(*[F.col(f"c_{a}_{b}") for a, b in pairs_of(assets)]))


def structure_break(df: DataFrame, assets: Sequence[str], baseline: dict[tuple[str, str], float], out: str = "structure_break") -> DataFrame:
    """Frobenius norm of the correlation matrix less `baseline`."""
    return df.withColumn(out, F.sqrt(2 * sum((F.pow(F.col(f"c_{a}_{b}") - float(baseline[a, b]), 2) for a, b in pairs_of(assets)), F.lit(0.0))))


def baseline_corr(train: DataFrame, assets: Sequence[str]) -> dict[tuple[str, str], float]:
    row = train.agg(*[F.corr(a, b).alias(f"c_{a}_{b}") for a, b in pairs_of(assets)]).first()
    return {(a, b): row[f"c_{a}_{b}"] for a, b in pairs_of(assets)}


def dominant_driver(df: DataFrame, assets: Sequence[str], ent: Ent, t: str, n: int = 252, out: str = "dominant", rows: int = BLOCK_ROWS) -> DataFrame:
    """Asset with the largest variance in the n rows before; the first on ties. Sliding sums over blocks with halo rows."""
    cur = halo(positions(df.withColumn("_there", F.lit(1.0)), ent, t), rows, n)

    def best(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        var = np.column_stack([shift(rolling(x[a], "var", n, 2), 1) for a in assets])
        full = shift(rolling(x["_there"], "mean", n), 1) == 1
        known = ~np.isnan(var).all(axis=1) & full
        return {"_best": np.where(known, np.where(np.isnan(var), -np.inf, var).argmax(axis=1), np.nan)}

    pick: Column = reduce(lambda c, x: c.when(F.col("_best") == x[0], x[1]), enumerate(assets), F)
    found = map_blocks(cur, ent, [*assets, "_there"], best, ["_best"]).withColumn(out, pick)
    return found.drop("_best", "_there")


def causal_stress(df: DataFrame, train: DataFrame) -> DataFrame:
    """Half the rank of connectedness and half the rank of the structure break against training rows."""
    for c in ("connectedness", "structure_break"):
        df = rank_vs_reference(df, c, train.select(c), f"{c}_rank")
    return df.withColumn("stress_composite", 0.5 * F.col("connectedness_rank") + 0.5 * F.col("structure_break_rank"))


def causal_score(df: DataFrame, ent: Ent, t: str, train_until, window: int = 252, assets: dict = ASSETS) -> DataFrame:
    """Changes, rolling correlations and stress of every row, measured against rows up to `train_until`."""
    changes = asset_changes(df, ent, t, assets)
    assets = [c for c in changes.columns if c not in (*ent, t)]
    train = F.col(t) <= F.lit(train_until)
    corr = connectedness(rolling_corr_matrix(changes, assets, ent, t, window), assets)
    corr = dominant_driver(structure_break(corr, assets, baseline_corr(changes.filter(train), assets)), assets, ent, t, window)
    corr = stage(corr, "causal")  # read by both ranks and by the result
    return causal_stress(corr, corr.filter(train))
