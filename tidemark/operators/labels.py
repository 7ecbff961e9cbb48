"""Forward drawdown labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import Ent, next_rows, order


def forward_maxdd(df: DataFrame, px: str, h: int, ent: Ent, t: str, out: str = "fwd_maxdd") -> DataFrame:
    """Deepest fall in percent from any price to a later one within rows [t, t+h].

    A run of rows has a summary (max, min, deepest fall); two adjoining runs combine to
    (max, min, greater of both falls and 1 - min of the second / max of the first). Runs of
    2^k rows come from two of 2^(k-1), so h costs about log2(h) passes of `lead` over one sort
    order instead of h comparisons a row. Null where a price is missing or the panel ends
    before t+h: the label isn't known there.
    """
    w = order(ent, t)
    level = {"mx": F.col(px).cast("double"), "mn": F.col(px).cast("double"), "dd": F.lit(0.0)}
    done: dict[str, str] | None = None
    cur = df.withColumns({f"_{k}0": v for k, v in level.items()})
    rest, size, used, k = h + 1, 1, 0, 0
    join = lambda a, b: {
        "mx": F.greatest(a["mx"], b["mx"]), "mn": F.least(a["mn"], b["mn"]), "dd": F.greatest(a["dd"], b["dd"], 1 - F.try_divide(b["mn"], a["mx"])),
    }
    temp = ["_mx0", "_mn0", "_dd0"]
    while rest:
        own = {x: f"_{x}{k}" for x in level}
        if rest & 1:
            part = {x: F.lead(c, used).over(w) if used else F.col(c) for x, c in own.items()}
            new = part if done is None else join({x: F.col(c) for x, c in done.items()}, part)
            names = {x: f"_s{x}{k}" for x in level}
            cur = cur.withColumns({names[x]: new[x] for x in level})
            temp += names.values()
            done, used = names, used + size
        rest >>= 1
        if rest:
            a = {x: F.col(c) for x, c in own.items()}
            b = {x: F.lead(c, size).over(w) for x, c in own.items()}
            cur = cur.withColumns({f"_{x}{k + 1}": e for x, e in join(a, b).items()})
            temp += [f"_{x}{k + 1}" for x in level]
            k, size = k + 1, size * 2
    whole = F.count(px).over(next_rows(h, ent, t)) == h + 1
    return cur.withColumn(out, F.when(whole, F.col(done["dd"]) * 100)).drop(*temp)


def crash_label(dd: str | Column, x_pct: float | Column) -> Column:
    """1.0 or 0.0; null stays null, never 0."""
    dd = F.col(dd) if isinstance(dd, str) else dd
    return F.when(dd.isNotNull(), (dd >= x_pct).cast("double"))


def label_coverage(df: DataFrame, px: str, xs: list[float], hs: list[int], ent: Ent, t: str) -> DataFrame:
    """Per entity, x and h: n_dates, n_scorable, n_positive, base_rate. Each horizon is computed once."""
    cur = df
    for h in hs:
        cur = forward_maxdd(cur, px, h, ent, t, f"_dd{h}")
    grid = F.array(*[F.struct(F.lit(float(x)).alias("x_pct"), F.lit(h).alias("horizon"), F.col(f"_dd{h}").alias("dd")) for x in xs for h in hs])
    long = cur.select(*ent, F.explode(grid).alias("g")).select(*ent, "g.*").withColumn("y", crash_label("dd", F.col("x_pct")))
    return long.groupBy(*ent, "x_pct", "horizon").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count("y").alias("n_scorable"), F.sum("y").cast("long").alias("n_positive"),
        F.try_divide(F.sum("y"), F.count("y")).alias("base_rate"),
    )
