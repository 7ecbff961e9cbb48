"""Small numpy helpers that run inside tasks or on d x d matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Columns of a batch as an (n, d) matrix; nulls are NaN."""
    return np.column_stack([batch.column(c).to_pandas().to_numpy(float) for c in columns])


def vector_sum(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """Sum of one vector per task. The vectors are added in Spark by element; d numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = make(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out, pa.float64())], ["i", "v"])

    rows = df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows]) if rows else None


def ledoit_wolf(n: int, gram: np.ndarray, fourth: float) -> tuple[np.ndarray, float]:
    """(covariance, shrinkage) from X'X and the sum of |x|^4 of n centred rows."""
    p = len(gram)
    s = gram / n
    mu = np.trace(s) / p
    delta = ((s**2).sum() - p * mu**2) / p
    beta = min((fourth / n - (s**2).sum()) / (n * p), delta)
    shrink = 0.0 if delta <= 0 else max(0.0, beta / delta)
    return (1 - shrink) * s + shrink * mu * np.eye(p), shrink


def average_path(n: float) -> float:
    """Mean depth of a failed search in a binary search tree of n points."""
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int]]:
    """Random isolation tree as rows (feature or -1, cut or path length, left, right)."""
    nodes: list[tuple[int, float, int, int]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append((-1, level + average_path(len(rows)), -1, -1))
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
        if level < depth and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            below = rows[:, f] < cut
            nodes[at] = (f, cut, grow(rows[below], level + 1), grow(rows[~below], level + 1))
        return at

    grow(x, 0)
    return nodes


def path_lengths(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in trees:
        feature, cut, left, right = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] < cut[node], left[node], right[node])
        total += cut[at]
    return total / len(trees)


def log_gauss(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log densities (n, k); missing coordinates of a row make it uninformative."""
    out = np.zeros((len(x), len(means)))
    ok = ~np.isnan(x).any(axis=1)
    for k, (m, c) in enumerate(zip(means, covs)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x[ok] - m).T)
        out[ok, k] = -0.5 * ((z**2).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
    return out


def hmm_forward(dens: np.ndarray, start: np.ndarray, trans: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Normalised filtered posteriors; `state` carries on from an earlier row."""
    out = np.empty_like(dens)
    for i, row in enumerate(dens):
        prior = start if state is None else state @ trans
        a = prior * np.exp(row - row.max())
        state = out[i] = a / a.sum()
    return out


def hmm_expect(
    dens: np.ndarray, start: np.ndarray, trans: np.ndarray, entry: np.ndarray | None = None, exit_: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(posteriors, expected moves, log likelihood given the past) of a stretch by scaled forward and backward passes.

    `entry` is the filtered posterior of the row before it (None: the sequence starts here; else
    the move into the stretch counts), `exit_` the likelihood of what follows by last state, up to a factor.
    """
    n, k = dens.shape
    top = dens.max(axis=1)
    b = np.exp(dens - top[:, None])
    alpha, scale, beta = np.empty((n, k)), np.empty(n), np.ones((n, k))
    for i in range(n):
        before = entry if i == 0 else alpha[i - 1]
        a = b[i] * (start if before is None else before @ trans)
        scale[i] = a.sum()
        alpha[i] = a / scale[i]
    if exit_ is not None:
        beta[-1] = exit_ / (alpha[-1] @ exit_)
    for i in range(n - 2, -1, -1):
        beta[i] = trans @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
    moves = np.einsum("ti,ij,tj->ij", alpha[:-1], trans, b[1:] * beta[1:] / scale[1:, None])
    if entry is not None:
        moves += np.outer(entry, b[0] * beta[0] / scale[0]) * trans
    return alpha * beta, moves, float(np.log(scale).sum() + top.sum())


def hmm_transfer(dens: np.ndarray, trans: np.ndarray, first: bool) -> np.ndarray:
    """Product of the steps (move, then emit) over a stretch, up to a factor; its first row has no move where the sequence starts.

    Neighbours are multiplied in pairs, so n rows are about log2 n products of stacks of matrices.
    """
    steps = trans[None] * np.exp(dens - dens.max(axis=1, keepdims=True))[:, None, :]
    if first:
        steps[0] = np.diag(np.exp(dens[0] - dens[0].max()))
    while len(steps) > 1:
        if len(steps) % 2:
            steps = np.concatenate([steps, np.eye(len(trans))[None]])
        steps = steps[0::2] @ steps[1::2]
        steps /= steps.max(axis=(1, 2), keepdims=True)
    return steps[0]


def bounded(weights: np.ndarray, floor: float, cap: float, rounds: int = 50) -> np.ndarray:
    """Clip to [floor, cap] and renormalise until both hold."""
    for _ in range(rounds):
        w = np.clip(weights, floor, cap)
        w = w / w.sum()
        if np.allclose(w, weights, atol=1e-12):
            break
        weights = w
    return weights


def frame(rows: list, columns: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(columns))
