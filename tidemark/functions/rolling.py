"""Rolling statistics whose cost doesn't grow with the window, over time blocks with halo rows."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidemark.functions.blocks import BLOCK_ROWS, blocks, map_blocks, numbers, with_columns
from tidemark.functions.windows import Ent
from tidemark.sources.staging import stage


@dataclass(frozen=True)
class Rolled:
    """`stat` of `column` (corr: with `other`; acf: at `lag`) over the last `n` rows; null below `min_periods` (default n) values."""

    stat: str
    column: str
    n: int
    min_periods: int | None = None
    other: str | None = None
    lag: int = 0


def shift(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]]) if k else x


def divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def pct(x: np.ndarray, k: int) -> np.ndarray:
    return divide(x, shift(x, k)) - 1


def rolling(x: np.ndarray, stat: str, n: int, min_periods: int | None = None) -> np.ndarray:
    """mean, std (sample), max, min, skew and kurt (bias-corrected) by pandas' sliding sums; skew and kurt of equal values are NaN."""
    w = pd.Series(x).rolling(n, min_periods=n if min_periods is None else min_periods)
    out = getattr(w, stat)().to_numpy()
    return np.where(w.max() == w.min(), np.nan, out) if stat in ("skew", "kurt") else out


def rolling_corr(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Correlation over windows of n whole pairs, from running sums of centred values; NaN where a side doesn't vary."""
    both = ~(np.isnan(x) | np.isnan(y))
    a, b = (np.where(both, v - (v[both].mean() if both.any() else 0.0), 0.0) for v in (x, y))
    total = lambda v: (c := np.concatenate([[0.0], np.cumsum(v)]))[n:] - c[: max(0, len(c) - n)]
    if len(x) < n:
        return np.full(len(x), np.nan)
    sx, sy, xy, xx, yy, m = (total(v) for v in (a, b, a * b, a * a, b * b, both.astype(float)))
    same = np.zeros(len(m), bool)
    for v in (x, y):
        w = pd.Series(np.where(both, v, np.nan)).rolling(n, min_periods=n)
        same |= (w.max() == w.min()).to_numpy()[n - 1 :]
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (xy - sx * sy / n) / np.sqrt(np.maximum(xx - sx**2 / n, 0.0) * np.maximum(yy - sy**2 / n, 0.0))
    return np.concatenate([np.full(n - 1, np.nan), np.where((m == n) & ~same, r, np.nan)])


def since_first_max(x: np.ndarray, n: int) -> np.ndarray:
    """Rows since the first maximum of a full window; a queue of candidates, each row enters and leaves once."""
    out, queue, run = np.full(len(x), np.nan), deque(), 0
    for i, v in enumerate(x.tolist()):
        run = run + 1 if v == v else 0
        if run == 0:
            queue.clear()
            continue
        while queue and x[queue[-1]] < v:
            queue.pop()
        queue.append(i)
        if queue[0] <= i - n:
            queue.popleft()
        if run >= n:
            out[i] = i - queue[0]
    return out


def compute(r: Rolled, x: dict[str, np.ndarray]) -> np.ndarray:
    c = x[r.column]
    if r.stat == "corr":
        return rolling_corr(c, x[r.other], r.n)
    if r.stat == "acf":
        whole = pd.Series(c).rolling(r.n, min_periods=r.n).count().to_numpy() == r.n
        return np.where(whole, rolling_corr(c, shift(c, r.lag), r.n - r.lag), np.nan)
    if r.stat == "since_max":
        return since_first_max(c, r.n)
    return rolling(c, r.stat, r.n, r.min_periods)


def rolled(df: DataFrame, specs: dict[str, Rolled], ent: Ent, t: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` with one column per spec. A row costs the same for any window, and an entity of any length is many tasks."""
    needs = sorted({c for r in specs.values() for c in (r.column, r.other) if c})
    cur = blocks(df, ent, t, rows, max(r.n for r in specs.values()) - 1)
    return map_blocks(cur, ent, needs, lambda x: {out: compute(r, x) for out, r in specs.items()}, list(specs))


def _first(x: np.ndarray) -> float:
    known = x[~np.isnan(x)]
    return float(known[0]) if len(known) else np.nan


def _running(x: np.ndarray, n: float, s: float, q: float, at: float, min_periods: int) -> np.ndarray:
    """Expanding z of a block from what the blocks before hold: count, sum and sum of squares of x - at."""
    known = ~np.isnan(x)
    d = np.where(known, x - at, 0.0)
    n, s, q = n + np.cumsum(known), s + np.cumsum(d), q + np.cumsum(d * d)
    with np.errstate(divide="ignore", invalid="ignore"):
        std = np.sqrt(np.maximum(q - s * s / n, 0.0) / (n - 1))
        z = (d - s / n) / np.where(std > 0, std, np.nan)
    return np.where(known & (n >= min_periods), z, np.nan)


def expanding_z_columns(cur: DataFrame, columns: dict[str, str], ent: Ent, long: bool, min_periods: int = 252) -> DataFrame:
    """`cur` (rows of blocks, with _pos and _block) with `out`: the column's distance from its mean so far in deviations so far.

    Sums are kept of differences from the entity's first value, so equal values give exactly no
    deviation. For entities of several blocks (`long`) each block sends its sums, which an entity
    adds up in block order, few numbers a block.
    """
    if not columns:
        return cur
    sources = list(columns.values())
    fields = [f for f in cur.schema.fields if f.name not in ("_pos", "_block", *sources)]
    schema = StructType(fields)
    for out in columns:
        schema = schema.add(out, "double")
    drop = ["_pos", "_block", *sources]

    def finish(table: pa.Table, held: dict[str, tuple[float, float, float, float]]) -> pa.Table:
        table = table.sort_by("_pos")
        x = numbers(table, sources)
        made = {out: _running(x[c], *held[c], min_periods) if c in held else _running(x[c], 0.0, 0.0, 0.0, _first(x[c]), min_periods) for out, c in columns.items()}
        return with_columns(table, made).drop_columns(drop)

    if not long:
        return cur.groupBy(*ent, "_block").applyInArrow(lambda table: finish(table, {}), schema)
    kinds = dict(cur.dtypes)
    keys = "".join(f"`{c}` {kinds[c]}, " for c in ent)
    cur = stage(cur, "local")  # read for the sums and again for the result

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        rows = []
        for c in sources:
            x = pdf[c].to_numpy(float)
            at, known = _first(x), x[~np.isnan(x)]
            rows.append((c, len(known), (known - at).sum(), ((known - at) ** 2).sum(), at))
        return pd.DataFrame(rows, columns=["c", "n", "s", "q", "at"]).assign(**{k: pdf[k].iloc[0] for k in (*ent, "_block")})

    def ahead(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in pdf.rename(columns={"_block": "block"}).sort_values("block").groupby("c", sort=False):
            n, s, q, at = 0.0, 0.0, 0.0, np.nan
            for r in rows.itertuples():
                first = r.at if np.isnan(at) else at
                out.append((r.block, r.c, n, s, q, first))
                if r.n:
                    far, at = r.at - first, first
                    n, s, q = n + r.n, s + r.s + r.n * far, q + r.q + 2 * far * r.s + r.n * far * far
        return pd.DataFrame(out, columns=["_block", "c", "n", "s", "q", "at"]).assign(**{k: pdf[k].iloc[0] for k in ent})

    numbers_of = "c string, n double, s double, q double, at double"
    each = cur.select(*ent, "_block", "_pos", *sources).groupBy(*ent, "_block").applyInPandas(sums, f"{keys}_block long, {numbers_of}")
    entries = each.groupBy(*ent).applyInPandas(ahead, f"{keys}_block long, {numbers_of}")

    def both(table: pa.Table, entry: pa.Table) -> pa.Table:
        return finish(table, {r["c"]: (r["n"], r["s"], r["q"], np.nan if r["at"] is None else r["at"]) for r in entry.to_pylist()})

    return cur.groupBy(*ent, "_block").cogroup(entries.groupBy(*ent, "_block")).applyInArrow(both, schema)
