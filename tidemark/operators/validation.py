"""Walk-forward folds, metrics, calibration and backtest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Ent, last_rows, order, so_far
from tidemark.operators.engines import nearest
from tidemark.sources.staging import stage

# Fixed values of the kill criteria.
SLOPE, MIN_CAGR_DELTA, MAX_DD_RATIO, MAX_WEIGHT, FIRE_PCT = (0.5, 1.5), -2.0, 1.10, 0.90, (0.1, 10.0)
#: Parts of a group whose rows are ranked on their own.
SALTS = 256


def walk_forward_folds(df: DataFrame, cutoffs: Sequence[str], t: str) -> DataFrame:
    """Rows of each fold's score window [cutoff, next cutoff], both ends in, so a boundary day is in two folds."""
    ends = [*cutoffs[1:], None]
    folds = F.filter(F.array(*[
        F.when((F.col(t) >= F.lit(a).cast("date")) & (F.lit(True) if b is None else F.col(t) <= F.lit(b).cast("date")), F.lit(i + 1)) for i, (a, b) in enumerate(zip(cutoffs, ends))
    ]), lambda x: x.isNotNull())
    return df.withColumn("fold", F.explode(folds))


def pool_folds(df: DataFrame, ent: Ent, t: str) -> DataFrame:
    """One row per (ent, t): the earliest fold's."""
    w = Window.partitionBy(*ent, t).orderBy("fold")
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def blind_split(df: DataFrame, boundary: str, t: str) -> DataFrame:
    """`part`: fit before the boundary, score from it on."""
    return df.withColumn("part", F.when(F.col(t) < F.lit(boundary).cast("date"), "fit").otherwise("score"))


def holdout_window(df: DataFrame, lock: str, ent: Ent, t: str, needed: int = 126) -> DataFrame:
    """Rows strictly after the lock date, whether there are enough, and how many are missing."""
    n = F.count_if(F.col(t) > F.lit(lock).cast("date"))
    return df.groupBy(*ent).agg(n.alias("n_rows"), (n >= needed).alias("ready"), F.greatest(F.lit(0), F.lit(needed) - n).alias("remaining"))


def confusion(df: DataFrame, fires: Column, y: str, by: Sequence[str]) -> DataFrame:
    """Counts and rates of fires against labels. n_fires and fire_pct use all rows, the rest rows with a label."""
    hit = lambda f, v: F.count_if(f & (F.col(y) == v))
    one = df.groupBy(*by).agg(
        hit(fires, 1).alias("tp"), hit(fires, 0).alias("fp"), hit(~fires, 1).alias("fn"), hit(~fires, 0).alias("tn"), F.avg(y).alias("base_rate"),
        F.count_if(fires).alias("n_fires"), (F.count_if(fires) * 100.0 / F.count(F.lit(1))).alias("fire_pct"),
    )
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall), "lift": F.try_divide(precision, F.col("base_rate"))})


def fire_leads(df: DataFrame, fires: Column, px: str, x_pct: float, h: int, ent: Ent, t: str) -> DataFrame:
    """Per fire the first offset in [t, t+h] at which the fall from the running high reaches x %; null if none.

    Only fires are expanded, to h+1 offsets each. Windows cut off by the end count from 2 rows on; null prices are skipped.
    """
    placed = df.withColumn("_pos", F.row_number().over(order(ent, t))).withColumn("_fire", fires)
    prices = placed.select(*ent, F.col("_pos").alias("_at"), F.col(px).alias("_p")).filter("_p IS NOT NULL")
    steps = placed.filter("_fire").select(*ent, t, "_pos", F.explode(F.sequence(F.lit(0), F.lit(h))).alias("offset")).withColumn("_at", F.col("_pos") + F.col("offset"))
    path = steps.join(prices, [*ent, "_at"])
    w = Window.partitionBy(*ent, "_pos").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    hit = path.withColumn("_hit", F.when((1 - F.col("_p") / F.max("_p").over(w)) * 100 >= x_pct, F.col("offset")))
    return hit.groupBy(*ent, t, "_pos").agg(F.min("_hit").alias("lead"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(*ent, t, "lead")


def lead_times(df: DataFrame, fires: Column, px: str, x_pct: float, h: int, ent: Ent, t: str) -> DataFrame:
    return fire_leads(df, fires, px, x_pct, h, ent, t).groupBy(*ent).agg(F.count("lead").alias("n_leads"), F.median("lead").alias("median_lead"), F.avg("lead").alias("mean_lead"))


def by_archetype(df: DataFrame, fires: Column, tag: str, y: str, px: str, x_pct: float, h: int, ent: Ent, t: str) -> DataFrame:
    """Per tag: fires, precision, median lead and the base rate of its labelled rows; nulls where it never fires."""
    leads = fire_leads(df, fires, px, x_pct, h, ent, t)
    cur = df.join(leads, [*ent, t], "left")
    agg = cur.groupBy(tag).agg(
        F.count_if(fires).alias("n_fires"), F.avg(F.when(fires, F.col(y))).alias("precision"), F.median(F.when(fires, F.col("lead"))).alias("median_lead"), F.avg(y).alias("_base")
    )
    return agg.withColumn("base_rate", F.when(F.col("n_fires") > 0, F.col("_base"))).drop("_base")


def calibration_table(df: DataFrame, p: str, y: str, by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Equal bins of [0, 1], closed on the right (0 is in the first): mean p, mean y, n."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by, F.greatest(F.ceil(F.col(p) * n_bins), F.lit(1)).alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))


def calibration_summary(df: DataFrame, p: str, y: str, by: Sequence[str] = (), n_bins: int = 10, eps: float = 1e-9) -> DataFrame:
    """Brier score and skill, log loss, base rate, and the line through the bins, weighted by n squared."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    one = rows.groupBy(*by).agg(
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss"), F.avg(y).alias("base_rate")
    ).withColumn("brier_skill", 1 - F.try_divide(F.col("brier"), F.col("base_rate") * (1 - F.col("base_rate"))))
    w = F.pow(F.col("n").cast("double"), 2)
    x, v = F.col("mean_p"), F.col("mean_y")
    s = calibration_table(df, p, y, by, n_bins).groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * v).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * v).alias("wxy"))
    slope = F.try_divide(F.expr("w * wxy - wx * wy"), F.expr("w * wxx - wx * wx"))
    line = s.select(*by, slope.alias("slope"), ((F.col("wy") - slope * F.col("wx")) / F.col("w")).alias("intercept"))
    return one.join(line, list(by)) if by else one.crossJoin(line)  # one row each


def backtest(df: DataFrame, fires: Column, px: str, ent: Ent, t: str, hold: int = 21, bps: float = 5.0) -> DataFrame:
    """In cash while any fire stands in the last 21 rows, from the next row on, against holding throughout."""
    w = order(ent, t)
    cur = df.withColumn("_r", F.coalesce(F.try_divide(F.col(px), F.lag(px).over(w)) - 1, F.lit(0.0)))
    cur = cur.withColumn("_out", F.max(fires.cast("int")).over(last_rows(hold, ent, t))).withColumn("_in", 1 - F.coalesce(F.lag("_out").over(w), F.lit(0)))
    cur = cur.withColumn("_switch", F.coalesce((F.col("_in") != F.lag("_in").over(w)).cast("int"), F.lit(0)))
    cur = cur.withColumn("_s", F.col("_in") * F.col("_r") - F.col("_switch") * bps / 1e4)
    for r, name in (("_s", "strategy"), ("_r", "hold")):
        cur = cur.withColumn(f"_e_{name}", F.exp(F.sum(F.log1p(r)).over(so_far(ent, t))))
        cur = cur.withColumn(f"_d_{name}", F.col(f"_e_{name}") / F.max(f"_e_{name}").over(so_far(ent, t)) - 1)
    aggs = []
    for r, name in (("_s", "strategy"), ("_r", "hold")):
        year = F.lit(252.0) / F.count(F.lit(1))
        aggs += [
            ((F.exp(F.sum(F.log1p(r)) * year) - 1) * 100).alias(f"{name}_cagr"), (F.stddev_samp(r) * 252**0.5 * 100).alias(f"{name}_vol"),
            F.try_divide(F.avg(r) * 252**0.5, F.stddev_samp(r)).alias(f"{name}_sharpe"), F.try_divide(F.avg(r) * 252**0.5, F.stddev_samp(F.when(F.col(r) < 0, F.col(r)))).alias(f"{name}_sortino"),
            (F.min(f"_d_{name}") * 100).alias(f"{name}_max_drawdown"),
        ]
    out = cur.groupBy(*ent).agg(*aggs, F.sum("_switch").alias("n_switches"), (F.avg("_in") * 100).alias("time_in_market_pct"))
    return out.withColumns({"cagr_delta": F.col("strategy_cagr") - F.col("hold_cagr"), "drawdown_ratio": F.try_divide(F.col("strategy_max_drawdown"), F.col("hold_max_drawdown"))})


def kill_check(metrics: DataFrame) -> DataFrame:
    """Pass and failed criteria from slope, cagr_delta, drawdown_ratio, max_weight and fire_pct; a null fails."""
    tests = {
        "calibration": F.col("slope").between(*SLOPE), "cagr": F.col("cagr_delta") >= MIN_CAGR_DELTA, "drawdown": F.col("drawdown_ratio") <= MAX_DD_RATIO,
        "weight": F.col("max_weight") < MAX_WEIGHT, "fires": F.col("fire_pct").between(*FIRE_PCT),
    }
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in tests.items()]), lambda x: x.isNotNull())
    return metrics.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.col("failed") == "")


def purged_splits(spark: SparkSession, n: int, window: int = 252, step: int = 21, min_train: int = 1260, purge: int = 21) -> DataFrame:
    """(fold, train_end, test_start, test_end): train [0, e), a gap, then the test window."""
    folds = spark.range(max(0, (n - min_train - purge - window) // step + 1))
    end = F.col("id") * step + min_train
    return folds.select(F.col("id").alias("fold"), end.alias("train_end"), (end + purge).alias("test_start"), (end + purge + window).alias("test_end"))


def walk_forward_run(df: DataFrame, splits: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, ent: Ent, t: str) -> DataFrame:
    """A user's model per (entity, fold): run(train, test) -> rows. The splits table is small by construction.

    Training rows are repeated per fold since a user's model needs them all; fits that are sums
    should take prefix aggregates instead.
    """
    placed = df.withColumn("_pos", F.row_number().over(order(ent, t)) - 1)
    part = F.when(F.col("_pos") < F.col("train_end"), 0).when(F.col("_pos").between(F.col("test_start"), F.col("test_end") - 1), 1)
    rows = placed.join(F.broadcast(splits), F.col("_pos") < F.col("test_end")).withColumn("_part", part).filter("_part IS NOT NULL")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        return run(pdf[pdf["_part"] == 0], pdf[pdf["_part"] == 1])

    return rows.groupBy(*ent, "fold").applyInPandas(each, schema)


def smote_oversample(df: DataFrame, columns: Sequence[str], y: str, by: Sequence[str], k: int = 5, seed: int = 42, min_minority: int = 6) -> DataFrame:
    """Rows (by, columns, y, synthetic): minority rows of each group brought up to the majority by seeded interpolation.

    New rows are dealt evenly: each minority row starts need // n of them, and those first in hash
    order one more. A new row lies between its start and one of the start's k nearest minority rows
    of the group, drawn by hash; a start with nothing but copies of itself is repeated. The smallest
    class is the minority, the lower label on ties. Rows without a label and groups of one class or
    under `min_minority` minority rows pass as they are; rows with a null in `columns` start nothing.
    Ranks come from salted counts and neighbours from cells, so no group is one task's work.
    """
    base = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns], F.col(y).cast("int").alias(y))
    keyed = base.withColumn("_g", F.to_json(F.struct(F.lit(0).alias("_"), *by)))  # never null
    sizes = keyed.filter(F.col(y).isNotNull()).groupBy("_g", y).agg(F.count(F.lit(1)).alias("_n"))
    low, high = F.min(F.struct("_n", y)).alias("_low"), F.max("_n").alias("_high")
    needs = sizes.groupBy("_g").agg(low, high).filter((F.col("_high") > F.col("_low._n")) & (F.col("_low._n") >= min_minority))
    needs = needs.select("_g", F.col(f"_low.{y}").alias(y), (F.col("_high") - F.col("_low._n")).alias("_need"))
    small = keyed.join(needs, ["_g", y]).dropna(subset=list(columns)).withColumn("_h", F.xxhash64(F.lit(seed), *columns)).withColumn("_s", F.pmod("_h", F.lit(SALTS)))
    salts = small.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_m"))
    group = Window.partitionBy("_g")  # SALTS rows at most
    before = group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    salts = salts.select("_g", "_s", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"), F.sum("_m").over(group).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_g", "_s").orderBy("_h", *columns)) - 1 + F.col("_start")
    starts = small.join(salts, ["_g", "_s"]).withColumn("_r", rank).withColumn("_id", F.concat_ws("#", F.col("_r").cast("string"), "_g")).withColumn("w", F.array(*columns))
    copies = F.floor(F.col("_need") / F.col("_all")) + (F.col("_r") < F.col("_need") % F.col("_all")).cast("long")
    starts = stage(starts.select(*by, y, "_g", "_id", "_h", "_r", "w", copies.alias("_copies")), "smote")
    found = nearest(starts, starts, k, None, "_id", None, keep=["_id", "w"], within=["_g"])
    near = found.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("_near"))  # k at most
    drawn = starts.filter("_copies > 0").join(near, "_id", "left").withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "_h", "_r", "_j"), n)
    drawn = drawn.withColumn("_to", F.when(F.col("_near").isNotNull(), F.element_at("_near", (draw("to", F.size("_near")) + 1).cast("int"))["w"]).otherwise(F.col("w")))
    drawn = drawn.withColumn("_u", draw("step", F.lit(1 << 53)) / F.lit(float(1 << 53)))
    cells = [(F.col("w")[i] + F.col("_u") * (F.col("_to")[i] - F.col("w")[i])).alias(c) for i, c in enumerate(columns)]
    made = drawn.select(*by, *cells, y, F.lit(True).alias("synthetic"))
    return base.withColumn("synthetic", F.lit(False)).unionByName(made)


def _curve(df: DataFrame, p: str, y: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score, descending: true and false positives so far (tp, fp), and those before (tp0, fp0)."""
    steps = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, p).agg(F.sum(F.col(y).cast("double")).alias("_a"), F.sum(1 - F.col(y).cast("double")).alias("_b"))
    w = Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({"tp": F.sum("_a").over(w), "fp": F.sum("_b").over(w)}).withColumns({"tp0": F.col("tp") - F.col("_a"), "fp0": F.col("fp") - F.col("_b")})


def roc_auc(df: DataFrame, p: str, y: str, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve (ties count half), null with one class."""
    area = F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2)
    return _curve(df, p, y, by).groupBy(*by).agg(F.try_divide(area, F.max("tp") * F.max("fp")).alias("auc"))


def fold_metrics(df: DataFrame, p: str, y: str, by: Sequence[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 at 0.5, and AUC, per fold; rows without a prediction don't count."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    c = confusion(rows, F.col(p) >= 0.5, y, by)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    out = c.select(*by, F.try_divide(F.col("tp") + F.col("tn"), F.expr("tp + fp + fn + tn")).alias("accuracy"), zero("precision").alias("precision"), zero("recall").alias("recall"), zero("f1").alias("f1"))
    return out.join(roc_auc(rows, p, y, by), list(by), "left")


def aggregate_folds(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """metric, mean, std (population) over folds without nulls; 0 where there is none."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("std"))


def classification_report(df: DataFrame, p: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rates at 0.5, ROC and PR areas (trapezoid), Brier score and mean absolute calibration error over filled bins."""
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    c = confusion(rows, F.col(p) >= 0.5, y, by).select(*by, "tp", "fp", "fn", "tn", "precision", "recall", "f1").withColumns({
        "specificity": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")), "fpr": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), "fnr": F.try_divide(F.col("fn"), F.col("fn") + F.col("tp")),
    })
    curve = _curve(rows, p, y, by)
    before = F.when(F.col("tp0") + F.col("fp0") > 0, F.col("tp0") / (F.col("tp0") + F.col("fp0"))).otherwise(1.0)
    pr = curve.groupBy(*by).agg(F.try_divide(F.sum((F.col("tp") - F.col("tp0")) * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2), F.max("tp")).alias("pr_auc"))
    brier = rows.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    ece = calibration_table(rows, p, y, by).groupBy(*by).agg(F.avg(F.abs(F.col("mean_p") - F.col("mean_y"))).alias("calibration_error"))
    return reduce(lambda a, b: a.join(b, list(by)), (roc_auc(rows, p, y, by), pr, brier, ece), c)


def event_lead_backtest(df: DataFrame, p: str, crash: Column, ent: Ent, t: str, days: int = 60, threshold: float = 0.5) -> DataFrame:
    """Lead of the latest earlier warning within 60 days of each crash row; detection and false alarm rates.

    The latest warning before a row is a running value, so no crash meets all rows before it.
    """
    warn = F.col(p) > threshold
    cur = df.withColumn("_warn", F.last(F.when(warn, F.col(t)), True).over(order(ent, t).rowsBetween(Window.unboundedPreceding, -1)))
    lead = F.datediff(F.col(t), F.col("_warn"))
    cur = cur.withColumn("_lead", F.when(crash & (lead <= days), lead)).withColumn("_crash", crash).withColumn("_alarm", warn)
    return cur.groupBy(*ent).agg(
        F.count_if("_crash").alias("n_crashes"), F.count("_lead").alias("n_detected"), F.avg("_lead").alias("avg_lead"), F.min("_lead").alias("min_lead"), F.max("_lead").alias("max_lead"),
        F.try_divide(F.count("_lead"), F.count_if("_crash")).alias("detection_rate"), F.try_divide(F.count_if(F.col("_alarm") & ~F.col("_crash")), F.count_if("_alarm")).alias("false_alarm_rate"),
    )


def model_comparison(metrics: DataFrame, model: str, metric: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per model, one column per metric; missing ones are 0."""
    return metrics.groupBy(model).pivot(metric, list(names)).agg(F.first(value)).fillna(0.0, list(names))


def best_run(runs: DataFrame, metric: str, model: str | None = None, maximize: bool = True, key: str = "run_id") -> DataFrame:
    rows = runs if model is None else runs.filter(F.col("model") == model)
    return rows.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric) if maximize else F.asc(metric), key).limit(1)


def latest_runs(runs: DataFrame, models: Sequence[str], metrics: Sequence[str], start: str = "start_time", key: str = "run_id") -> DataFrame:
    newest = F.max(F.struct(start, key, *metrics)).alias("x")
    return runs.filter(F.col("model").isin(*models)).groupBy("model").agg(newest).select("model", "x.*")


def run_history(runs: DataFrame, model: str, limit: int = 10, start: str = "start_time", key: str = "run_id") -> DataFrame:
    return runs.filter(F.col("model") == model).orderBy(F.desc(start), F.desc(key)).limit(limit)
