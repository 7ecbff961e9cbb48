"""Drawdown episodes and crash records."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.blocks import BLOCK_ROWS, halo, positions
from tidemark.functions.windows import Ent, from_here, order, so_far
from tidemark.sources.staging import stage

# Upper bounds of severity in percent, and lower bounds of crash types.
SEVERITY = ((5, "micro"), (10, "minor"), (15, "moderate"), (20, "major"), (30, "severe"))
CRASH_TYPES = ((30, "Extreme"), (20, "Severe"), (15, "Major"), (10, "Moderate"))
MIN_ROWS = 100


def severity_tier(dd: str | Column) -> Column:
    dd = F.col(dd) if isinstance(dd, str) else dd
    return F.when(dd.isNull(), None).otherwise(reduce(lambda c, x: c.when(dd < x[0], x[1]), SEVERITY, F).otherwise("extreme"))


def crash_type(dd: str | Column) -> Column:
    dd = F.col(dd) if isinstance(dd, str) else dd
    return reduce(lambda c, x: c.when(dd >= x[0], x[1]), CRASH_TYPES, F).otherwise("Minor")


class Block:
    """One block's prices (halo rows first): where rows open, where each opened episode closes, and what a closed row leads to."""

    def __init__(self, p: np.ndarray, own: int, x: float, lookback: int) -> None:
        self.p, self.own, self.lookback = p, own, lookback
        self.high = pd.Series(p).rolling(lookback, min_periods=1).max().to_numpy()
        self.opens = own + np.flatnonzero(p[own:] / self.high[own:] - 1 <= -x / 100)
        self.close = self._closes()
        self.exit = np.full(len(self.opens), -1)  # by opening row: the row whose episode is open at the block's end
        after = np.searchsorted(self.opens, self.close + 1)
        for k in range(len(self.opens) - 1, -1, -1):
            if self.close[k] < 0:
                self.exit[k] = self.opens[k]
            elif after[k] < len(self.opens):
                self.exit[k] = self.exit[after[k]]

    def _closes(self) -> np.ndarray:
        """For each opening row the first later row at its high or above, -1 if none: a stack of rows that no nearer one tops."""
        out, stack, top, k = np.full(len(self.opens), -1), [], [], len(self.opens) - 1
        p = self.p.tolist()
        for j in range(len(p) - 1, self.own - 1, -1):
            if k >= 0 and self.opens[k] == j:
                at = bisect_right(top, -self.high[j]) - 1  # `top` holds negated prices, the nearest row last
                out[k], k = (stack[at] if at >= 0 else -1), k - 1
            while stack and -top[-1] <= p[j]:
                stack.pop(), top.pop()
            stack.append(j), top.append(-p[j])
        return out

    def peak(self, o: int) -> int:
        start = max(0, o - self.lookback + 1)
        return start + int(np.flatnonzero(self.p[start : o + 1] >= self.high[o])[-1])

    def after(self, row: int) -> int:
        """Of a closed `row`: the row whose episode is open at the end, or -1."""
        k = int(np.searchsorted(self.opens, row))
        return int(self.exit[k]) if k < len(self.opens) else -1

    def low(self, start: int, end: int) -> int:
        """First row of the least price in [start, end]."""
        return start + int(np.argmin(self.p[start : end + 1]))

    def open_state(self, o: int) -> tuple[int, float, int, float]:
        peak, low = self.peak(o), self.low(o, len(self.p) - 1)
        return peak, self.p[peak], low, self.p[low]


STATE = "peak_pos long, peak double, low_pos long, low double"


def _summary(b: Block, base: int) -> dict:
    """What a block does to any state it is entered with: closed, or open at a peak's price.

    An episode that comes in open ends at the first row at its price or above, one of the
    block's record highs; `upto` lists these highs, and `to` the state each leads to.
    """
    states: list[int] = []
    at = lambda o: -1 if o < 0 else states.index(o) if o in states[-1:] else (states.append(o), len(states) - 1)[1]
    closed = at(b.after(b.own))
    mine = b.p[b.own :]
    records = np.flatnonzero(mine > np.concatenate([[-np.inf], np.maximum.accumulate(mine)[:-1]]))
    upto, to = [], []
    for m in records:
        k = at(b.after(b.own + m + 1))
        if to and to[-1] == k:
            upto[-1] = mine[m]
        else:
            upto.append(mine[m]), to.append(k)
    full = [b.open_state(o) for o in states]
    low = b.low(b.own, len(b.p) - 1)
    return {"rows": len(mine), "closed": closed, "upto": upto, "to": to, "low_pos": base + low, "low": b.p[low],
            "s_peak_pos": [base + s[0] for s in full], "s_peak": [s[1] for s in full], "s_low_pos": [base + s[2] for s in full], "s_low": [s[3] for s in full]}


SUMMARY = "rows long, closed int, upto array<double>, to array<int>, low_pos long, low double, s_peak_pos array<long>, s_peak array<double>, s_low_pos array<long>, s_low array<double>"


def _entries(rows: list[dict]) -> list[dict]:
    """The state in which each block of an entity is entered, from the summaries in block order."""
    out, state = [], None
    for r in rows:
        out.append({"_block": r["_block"], **dict(zip(("peak_pos", "peak", "low_pos", "low"), state or (None,) * 4))})
        if state is None:
            k = r["closed"]
        elif not len(r["upto"]) or state[1] > r["upto"][-1]:
            state = (*state[:2], *((r["low_pos"], r["low"]) if r["low"] < state[3] else state[2:]))
            continue
        else:
            k = r["to"][int(np.searchsorted(r["upto"], state[1]))]
        state = None if k < 0 else tuple(r[f"s_{c}"][k] for c in ("peak_pos", "peak", "low_pos", "low"))
    return out


def _episodes(b: Block, base: int, entry: tuple | None, last: bool) -> list[tuple]:
    """(peak_pos, peak, low_pos, low, end_pos or None) of the episodes that end in the block, or at the entity's end."""
    out, row = [], b.own
    if entry is not None:
        back = np.flatnonzero(b.p[b.own :] >= entry[1])
        end = b.own + int(back[0]) if len(back) else len(b.p) - 1
        low = b.low(b.own, end)
        found = (*entry[:2], *((base + low, b.p[low]) if b.p[low] < entry[3] else entry[2:]))
        if len(back):
            out.append((*found, base + end))
        elif last:
            out.append((*found, None))
        row = end + 1
    while (k := int(np.searchsorted(b.opens, row))) < len(b.opens):
        o, end = int(b.opens[k]), int(b.close[k])
        peak, low = b.peak(o), b.low(o, end if end >= 0 else len(b.p) - 1)
        if end >= 0 or last:
            out.append((base + peak, b.p[peak], base + low, b.p[low], base + end if end >= 0 else None))
        if end < 0:
            break
        row = end + 1
    return out


def drawdown_episodes(df: DataFrame, px: str, x_pct: float, ent: Ent, t: str, min_duration: int = 5, lookback: int = 252, rows: int = BLOCK_ROWS) -> DataFrame:
    """Per entity the episodes that open at x % below the high of `lookback` rows and close at the peak's price.

    An episode depends on where the one before it closed. Blocks of `rows` rows therefore give
    a map from entry state to exit state, an entity's maps are composed in order, and each block
    runs once more from its entry state. Null prices are left out. Entities under `lookback` rows have none.
    """
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in ent)
    placed = stage(positions(df.filter(F.col(px).isNotNull()).select(*ent, t, F.col(px).cast("double").alias("_p")), ent, t), "placed")
    cur = halo(placed, rows, lookback - 1).drop(t)
    of_block, of_entity, of_episode = f"{keys}, _block long, {SUMMARY}", f"{keys}, _block long, _last boolean, {STATE}", f"{keys}, {STATE}, end_pos long"
    block_rows, entity_rows, episode_rows = (to_arrow_schema(StructType.fromDDL(x)) for x in (of_block, of_entity, of_episode))

    def block_of(table: pa.Table) -> tuple[Block, int]:
        table = table.sort_by("_pos")
        own = table.column("_own").to_numpy(zero_copy_only=False)
        return Block(table.column("_p").to_numpy(), int(np.argmax(own)) if own.any() else len(own), x_pct, lookback), table.column("_pos")[0].as_py()

    def summarise(key: tuple, table: pa.Table) -> pa.Table:
        b, base = block_of(table)
        got = [_summary(b, base)] if b.own < len(b.p) else []
        return _table(got, key, [*ent, "_block"], block_rows)

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["_block"])
        entries = _entries(found) if sum(r["rows"] for r in found) >= lookback else []
        for e in entries:
            e["_last"] = e["_block"] == found[-1]["_block"]
        return _table(entries, key, list(ent), entity_rows)

    def run(key: tuple, table: pa.Table, entry: pa.Table) -> pa.Table:
        found = []
        if entry.num_rows and table.num_rows:
            b, base = block_of(table)
            e = entry.to_pylist()[0]
            state = None if e["peak_pos"] is None else (e["peak_pos"], e["peak"], e["low_pos"], e["low"])
            found = [dict(zip(("peak_pos", "peak", "low_pos", "low", "end_pos"), r)) for r in _episodes(b, base, state, e["_last"]) if r[2] - r[0] >= min_duration]
        return _table(found, key[:-1], list(ent), episode_rows)

    summaries = cur.groupBy(*ent, "_block").applyInArrow(summarise, of_block)
    entries = summaries.groupBy(*ent).applyInArrow(compose, of_entity)
    found = cur.groupBy(*ent, "_block").cogroup(entries.groupBy(*ent, "_block")).applyInArrow(run, of_episode)
    return _dated(stage(found, "episodes"), placed, ent, t).withColumn("severity_tier", severity_tier("drawdown_pct"))


def _dated(found: DataFrame, placed: DataFrame, ent: Ent, t: str) -> DataFrame:
    """Episodes with times for positions: their few positions meet the entity's rows once."""
    marks = found.select(*ent, F.col("peak_pos").alias("_k"), F.posexplode(F.array("peak_pos", "low_pos", "end_pos")).alias("_i", "_pos")).filter("_pos IS NOT NULL")
    same = F.col("_pos") == F.col("_at")
    for i, c in enumerate(ent):
        same &= F.col(c).eqNullSafe(F.col(f"_e{i}"))
    times = marks.join(placed.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(ent)], F.col("_pos").alias("_at"), F.col(t).alias("_t")), same)
    by = times.groupBy(*ent, "_k").agg(*[F.max(F.when(F.col("_i") == i, F.col("_t"))).alias(n) for i, n in enumerate(("peak_date", "trough_date", "recovery_date"))])
    by = by.select(F.col("_k"), "peak_date", "trough_date", "recovery_date", *[F.col(c).alias(f"_e{i}") for i, c in enumerate(ent)])
    same = F.col("peak_pos") == F.col("_k")
    for i, c in enumerate(ent):
        same &= F.col(c).eqNullSafe(F.col(f"_e{i}"))
    return found.join(by, same).select(
        *ent, "peak_date", F.col("peak").alias("peak_price"), "trough_date", F.col("low").alias("trough_price"), "recovery_date", ((1 - F.col("low") / F.col("peak")) * 100).alias("drawdown_pct"),
        (F.col("low_pos") - F.col("peak_pos")).alias("duration_to_trough_td"), (F.col("end_pos") - F.col("low_pos")).alias("duration_to_recovery_td"),
    )


def _table(rows: list[dict], key: tuple, names: list[str], schema: pa.Schema) -> pa.Table:
    """Rows with the group's key in `names`."""
    return pa.Table.from_pylist([{**dict(zip(names, (k.as_py() for k in key))), **r} for r in rows], schema=schema)


def business_shift(day: Column, n: int) -> Column:
    """`day` moved by n business days; a weekend day first rolls in the direction of the move."""
    wd = F.weekday(day)  # Monday is 0
    if n < 0:
        start = F.date_sub(day, F.greatest(wd - 4, F.lit(0)))
        k, at = -n, F.least(wd, F.lit(4))
        return F.date_sub(start, (F.lit(k) + 2 * F.floor((F.lit(k) + 4 - at) / 5)).cast("int"))
    start = F.date_add(day, F.when(wd > 4, 7 - wd).otherwise(0))
    at = F.when(wd > 4, 0).otherwise(wd)
    return F.date_add(start, (F.lit(n) + 2 * F.floor((F.lit(n) + at) / 5)).cast("int"))


def normal_days(df: DataFrame, episodes: DataFrame, ent: Ent, t: str, buffer: int = 20) -> DataFrame:
    """Rows of `df` with `normal`: outside every [peak - buffer, (recovery or trough) + buffer] in business days.

    Intervals of one entity become a running count of starts minus ends over the union of
    rows and bounds, so the range join is one sort and emits no pairs.
    """
    lo = business_shift(F.col("peak_date"), -buffer)
    hi = business_shift(F.coalesce("recovery_date", "trough_date"), buffer)
    rows = df.select(*ent, F.col(t).alias("_t"), F.lit(0).alias("_d"), F.lit(1).alias("_o"), F.struct(*df.columns).alias("_row"))
    bound = lambda c, d, o: episodes.select(*ent, c.alias("_t"), F.lit(d).alias("_d"), F.lit(o).alias("_o"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*ent).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    open_ = rows.unionByName(bound(lo, 1, 0)).unionByName(bound(hi, -1, 2)).withColumn("_open", F.sum("_d").over(w))
    return open_.filter("_row IS NOT NULL").select("_row.*", (F.col("_open") == 0).alias("normal"))


def threshold_crashes(df: DataFrame, px: str, ent: Ent, t: str, threshold: float = 5.0, min_days: int = 5) -> DataFrame:
    """Crash records from the all-time-high drawdown; one record per entry into at least `threshold` percent.

    start: last row at the high; end: first later row out of the crash (or the last row);
    trough: first minimum of [start, end]; recovery: first row from end on at the peak's price.
    Records whose trough is under `min_days` calendar days after the peak are dropped, entities
    under 100 rows have none.
    """
    w, past, ahead = order(ent, t), so_far(ent, t), from_here(ent, t)
    cur = df.filter(F.col(px).isNotNull()).select(*ent, t, F.col(px).cast("double").alias("_p"))
    cur = cur.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*ent))).filter(F.col("_n") >= MIN_ROWS)
    cur = cur.withColumn("_high", F.max("_p").over(past)).withColumn("_dd", (F.col("_p") / F.col("_high") - 1) * 100).withColumn("_in", F.col("_dd") <= -threshold)
    cur = cur.withColumn("_entry", F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)))
    cur = cur.withColumns({
        "_peak": F.last(F.when(F.col("_dd") == 0, F.struct(F.col(t).alias("t"), F.col("_p").alias("p"))), True).over(past),
        "_back": F.min(F.when(F.col("_dd") == 0, F.col(t))).over(ahead),
        "_run": F.sum(F.col("_entry").cast("int")).over(past),
    })
    # the high stands from peak to end, so the lowest price is in the run of rows in the crash,
    # and the peak's price is met again at the next row without drawdown
    found = cur.filter("_in").groupBy(*ent, "_run").agg(
        F.min("_peak").alias("_peak"), F.min(F.struct("_p", F.col(t).alias("_t"))).alias("_low"), F.min("_back").alias("recovery_date")
    )
    return found.select(
        *ent, F.col("_peak.t").alias("start_date"), F.col("_low._t").alias("trough_date"), "recovery_date", F.col("_peak.p").alias("peak_price"),
        F.col("_low._p").alias("trough_price"), ((1 - F.col("_low._p") / F.col("_peak.p")) * 100).alias("max_drawdown"),
        F.datediff("recovery_date", "_low._t").alias("recovery_days"),
    ).filter(F.datediff("trough_date", "start_date") >= min_days)


def dedupe_crashes(crashes: DataFrame, ent: Ent) -> DataFrame:
    """One record per (start, trough): the deepest."""
    w = Window.partitionBy(*ent, "start_date", "trough_date").orderBy(F.desc("max_drawdown"), F.col("recovery_date").asc_nulls_last())
    return crashes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def crash_events(crashes: DataFrame, ent: Ent) -> DataFrame:
    """Event rows: end date, months to recovery, type and a note."""
    kind = crash_type("max_drawdown")
    return crashes.select(
        *ent, "start_date", F.coalesce("recovery_date", "trough_date").alias("end_date"), "trough_date", "recovery_date", "max_drawdown",
        F.when(F.col("recovery_days") != 0, F.floor(F.col("recovery_days") / 30)).cast("long").alias("recovery_months"), kind.alias("crash_type"),
        F.format_string("%s drawdown of %.1f%%", kind, F.col("max_drawdown")).alias("notes"),
    )


def crash_summary(events: DataFrame) -> DataFrame:
    """Count per type in a fixed order."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("Minor", "Moderate", "Major", "Severe", "Extreme")]), F.col("crash_type"))
    return events.groupBy("crash_type").agg(F.count(F.lit(1)).alias("n"), F.max("max_drawdown").alias("deepest")).withColumn("rank", rank).orderBy("rank")
