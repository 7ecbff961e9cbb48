"""Structured Streaming forms of the daily jobs. A run to the end gives what the batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.functions import vec
from tidemark.operators.alerts import ML_ALARM
from tidemark.operators.engines import Hmm
from tidemark.sources.staging import new_path, stage


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a query started inside takes over; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files at `path` (a file or a folder) as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], folder: str) -> None:
    """Process all that is there with `sink(batch, id)`; the checkpoint in `folder` lets a later run go on from there."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def _collected(stream: DataFrame, mode: str, name: str, folder: str | None) -> DataFrame:
    """All batches' rows with their `_batch`; a batch that is run again replaces its own folder.

    A shared `folder` that is given again holds the batches of earlier runs too; without one
    the run has a new folder and starts from the beginning.
    """
    folder = folder or new_path(stream.sparkSession, name)
    run_to_end(stream, mode, lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/rows/_batch={i}"), folder)
    schema = StructType(stream.schema.fields).add("_batch", "long")
    return stream.sparkSession.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def newest_rows(batch: DataFrame, key: Sequence[str], ts: str, days: int = 7) -> DataFrame:
    """Latest row per key among rows at most `days` days older than the batch's newest."""
    limit = batch.agg((F.max(ts) - F.expr(f"INTERVAL {days} DAYS")).alias("_limit"))  # one row
    fresh = batch.join(F.broadcast(limit), F.col(ts) >= F.col("_limit")).drop("_limit")
    rest = [c for c in batch.columns if c not in key]
    return fresh.groupBy(*key).agg(F.max_by(F.struct(*rest), ts).alias("x")).select(*key, "x.*")


def stream_upsert(stream: DataFrame, key: Sequence[str], ts: str, days: int = 7, folder: str | None = None, buckets: int = 64, compact: int = 8) -> DataFrame:
    """The table after every batch's newest rows were put in by key.

    A batch writes its rows alone, dealt to `buckets` by key; reading merges them, the last
    batch of a key wins. A bucket that more than `compact` batches have touched since its last
    base is merged into a new base, and no other is written anew. A batch that is run again
    replaces its own rows, and a base names the batch up to which it holds, so a later run with
    the same `folder` finds its state there alone.
    """
    spark = stream.sparkSession
    folder = folder or new_path(spark, "upsert")

    def sink(batch: DataFrame, i: int) -> None:
        new = newest_rows(batch, key, ts, days).select(*batch.columns).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/log/_batch={i}")
        touched = _changes(spark, folder, stream.schema).groupBy("_bucket").agg(F.countDistinct("_batch").alias("n")).filter(F.col("n") > compact)
        full = [r["_bucket"] for r in touched.collect()]  # buckets at most
        if full:
            merged = _merged(spark, folder, stream.schema, key, full)
            merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/base/_upto={i}")

    run_to_end(stream, "append", sink, folder)
    return _merged(spark, folder, stream.schema, key).drop("_bucket")


def _layers(spark: SparkSession, folder: str, schema: StructType, what: str, at: str) -> DataFrame:
    """The rows of all log batches or bases, each with its number `at` and `_bucket`."""
    full = StructType([*schema.fields]).add(at, "long").add("_bucket", "long")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{what}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{folder}/{what}").parquet(f"{folder}/{what}")


def _bases(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of every bucket's newest base, (_bucket, _upto) of these)."""
    base = _layers(spark, folder, schema, "base", "_upto")
    newest = base.groupBy("_bucket").agg(F.max("_upto").alias("_upto"))  # a row per bucket
    return base.join(F.broadcast(newest), ["_bucket", "_upto"], "left_semi"), newest


def _changes(spark: SparkSession, folder: str, schema: StructType, held: DataFrame | None = None) -> DataFrame:
    """Log rows that their bucket's newest base doesn't hold."""
    newest = _bases(spark, folder, schema)[1] if held is None else held
    log = _layers(spark, folder, schema, "log", "_batch").join(F.broadcast(newest), "_bucket", "left")
    return log.filter(F.col("_upto").isNull() | (F.col("_batch") > F.col("_upto"))).drop("_upto")


def _merged(spark: SparkSession, folder: str, schema: StructType, key: Sequence[str], only: list[int] | None = None) -> DataFrame:
    """Newest base and later changes, one row per key: that of the last batch."""
    base, newest = _bases(spark, folder, schema)
    both = base.withColumnRenamed("_upto", "_batch").select(*schema.fieldNames(), "_bucket", "_batch").unionByName(_changes(spark, folder, schema, newest).select(*schema.fieldNames(), "_bucket", "_batch"))
    if only is not None:
        both = both.filter(F.col("_bucket").isin(only))
    rest = [c for c in schema.fieldNames() if c not in key]
    last = both.groupBy("_bucket", *key).agg(F.max_by(F.struct(*rest), "_batch").alias("x"))
    return last.select("_bucket", *key, "x.*").select(*schema.fieldNames(), "_bucket")


def stream_daily_mean(stream: DataFrame, ent: Sequence[str], ts: str, value: str, late: str = "7 days", folder: str | None = None) -> DataFrame:
    """(ent, d, value): means of tumbling days; rows later than the watermark are dropped by it."""
    days = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(*ent, F.window(ts, "1 day").alias("w")).agg(F.avg(value).alias("value"))
    rows = _collected(days.select(*ent, F.to_date("w.start").alias("d"), "value"), "update", "daily", folder)
    w = Window.partitionBy(*ent, "d").orderBy(F.desc("_batch"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_batch")


def _by_entity(rows: pd.DataFrame, keys: list[str], old: dict[tuple, tuple], prepare: Callable, step: Callable) -> tuple[list[list], dict[tuple, tuple]]:
    """(columns of the output: keys, us and what `step` makes; new states) of rows (keys, us, values) of any entities.

    The values of all rows are prepared at once; each entity's then go through `step` in time order.
    """
    entity = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((rows["us"].to_numpy(), entity))
    put, entity = rows.iloc[order], entity[order]
    names = [_plain(put[k]) for k in keys]
    x = prepare(put.drop(columns=[*keys, "us"]).to_numpy(float))  # null is NaN
    starts = np.flatnonzero(np.diff(entity, prepend=-1)).tolist()
    outs, new = [], {}
    for at, end in zip(starts, [*starts[1:], len(put)]):
        ent = tuple(c[at] for c in names)
        made, new[ent] = step(x[at:end], old.get(ent))
        outs.append(made)
    return [*names, put["us"].tolist(), *(list(chain.from_iterable(cs)) for cs in zip(*outs))], new


def _plain(column: pd.Series) -> list:
    """Values with None for null."""
    return column.astype(object).where(column.notna(), None).tolist()


class _InOrder(StatefulProcessor):
    """`work(rows, old states) -> (output columns, new states)` per bucket of entities, each entity's rows in time order whatever order they come in.

    Rows wait in list state until the watermark has passed them; an event-time timer at the
    earliest one waiting then hands on all of the bucket that are due, in order. The calls to
    the state store are per bucket, not per entity, and an element of `rows` holds up to
    CHUNK rows as an array per column, so that no row is written or read by itself.
    """

    def __init__(self, row: str, state: str, names: list[str], keys: int, made: list[str], work: Callable) -> None:
        self.row, self.state, self.names, self.keys, self.made, self.work, self.chunk = row, state, names, keys, made, work, CHUNK

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.row)
        self.held = handle.getListState("held", self.state)

    def _packed(self, rows: pd.DataFrame) -> list[tuple]:
        rows = rows.astype({"us": "int64"})  # fails on a row without time
        parts = [rows.iloc[i : i + self.chunk] for i in range(0, len(rows), self.chunk)]
        return [tuple(_plain(p[c]) if i < self.keys else p[c].tolist() for i, c in enumerate(self.names)) for p in parts]

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        waiting = min(self.handle.listTimers(), default=None)
        first = -(-int(new["us"].min()) // 1000)
        self.rows.appendList(self._packed(new))
        if waiting is None or first < waiting:
            if waiting is not None:
                self.handle.deleteTimer(waiting)
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto, k = timerValues.getCurrentWatermarkInMs() * 1000, self.keys
        rows = pd.DataFrame({c: list(chain.from_iterable(v)) for c, v in zip(self.names, zip(*self.rows.get()))})
        ready = rows["us"] <= upto
        due, rest = rows[ready], rows[~ready]
        old = {tuple(r[:k]): tuple(r[k:]) for r in self.held.get()}
        made, new = self.work(due, old)
        self.held.put([(*ent, *state) for ent, state in (old | new).items()])
        if len(rest):
            self.rows.put(self._packed(rest))
            self.handle.registerTimer(-(-int(rest["us"].min()) // 1000))
        else:
            self.rows.clear()
        yield pd.DataFrame(dict(zip(self.made, made)))

    def close(self) -> None:
        pass


#: The state that timers and lists need: on local disk, its log in the checkpoint folder.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


#: Groups that the entities of a stream are dealt to; a checkpoint holds to its number.
BUCKETS = 512

#: Rows in an element of the list state at most.
CHUNK = 10_000


def _in_order(
    stream: DataFrame, ent: Sequence[str], t: str, out: str, state: str, columns: Sequence[str], step: Callable, name: str, folder: str | None, late: str, prepare: Callable = np.asarray,
) -> DataFrame:
    """Rows (ent, t, out) of `step(prepared values in time order, old state or None) -> (output columns, new state)` per entity, for rows up to `late` behind the newest.

    Entities are dealt to BUCKETS by hash, and a bucket is what the state store knows: calls to
    Python and to the store are as many as buckets, whatever the number of entities. What the
    watermark hasn't passed is waiting in the state; it is read there and worked off once more
    each time, so the result is whole, and a later run with the same `folder` still puts rows
    in between. Rows later than the watermark are dropped by it.
    """
    spark, kinds = stream.sparkSession, dict(stream.dtypes)
    folder = folder or new_path(spark, name)
    keys, values = [f"k{i}" for i in range(len(ent))], [f"v{i}" for i in range(len(columns))]
    us = F.unix_micros(F.col(t).cast("timestamp"))
    cur = stream.select(  # keys as text: nulls and large numbers pass through pandas unchanged
        F.pmod(F.xxhash64(*ent), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(t).cast("timestamp").alias("seen_at"),
        *[F.col(c).cast("string").alias(k) for c, k in zip(ent, keys)], us.alias("us"), *[F.col(c).cast("double").alias(v) for c, v in zip(columns, values)],
    )
    texts = "".join(f"{k} string, " for k in keys)
    row = ", ".join([*(f"{k} array<string>" for k in keys), "us array<long>", *(f"{v} array<double>" for v in values)])
    schema, states = f"{texts}us long, {out}", StructType.fromDDL(f"{texts}{state}").fieldNames()
    made = StructType.fromDDL(schema).fieldNames()

    def work(rows: pd.DataFrame, old: dict[tuple, tuple]) -> tuple[list[list], dict[tuple, tuple]]:
        return _by_entity(rows, keys, old, prepare, step)

    done = cur.withWatermark("seen_at", late).groupBy("bucket").transformWithStateInPandas(
        _InOrder(row, f"{texts}{state}", [*keys, "us", *values], len(keys), made, work), schema, "append", "EventTime")
    with _settings(spark, ROCKSDB):
        ready = _collected(done, "append", name, folder).drop("_batch")
        held = spark.read.format("statestore").option("path", f"{folder}/checkpoint")
        listed = lambda what: held.option("stateVarName", what).load().select("key.bucket", "list_element.*")
        waiting, kept = stage(listed("rows").select("bucket", F.inline(F.arrays_zip(*keys, "us", *values))), "rows"), stage(listed("held"), "held")

    def finish(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=made)
        old = {r[: len(keys)]: r[len(keys) :] for r in held[states].itertuples(index=False, name=None)}
        return pd.DataFrame(dict(zip(made, work(rows[[*keys, "us", *values]], old)[0])))

    tail = waiting.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInPandas(finish, schema)
    back = F.timestamp_micros("us").cast(kinds[t])
    rest = [c for c in made if c not in (*keys, "us")]
    return ready.unionByName(tail).select(*[F.col(k).cast(kinds[c]).alias(c) for k, c in zip(keys, ent)], back.alias(t), *rest)


def stream_roc_alarm(stream: DataFrame, p: str, ent: Sequence[str], t: str, thresholds=ML_ALARM, folder: str | None = None, late: str = "1 day") -> DataFrame:
    """(ent, t, value, alarm) with the last 20 values of each entity as state."""
    deepest = max(k for k, _, _ in thresholds)

    def step(values: np.ndarray, old):
        past, n = (list(old[0]), old[1]) if old else ([], 0)
        alarms, mine = [], values[:, 0].tolist()
        for x in mine:
            alarm = "none"
            for k, limit, name in thresholds if n >= 2 else ():
                if len(past) >= k and (0.0 if past[-k] == 0 else (x - past[-k]) / past[-k] / k) > limit:
                    alarm = name
                    break
            alarms.append(alarm)
            past, n = [*past, x][-deepest:], n + 1
        return (mine, alarms), (past, n)

    return _in_order(stream, ent, t, "value double, alarm string", "past array<double>, n long", [p], step, "alarm", folder, late)


def stream_base_rate(
    stream: DataFrame, y: str, h: int, fallback: float, ent: Sequence[str], t: str, window: int = 1260, every: int = 21, min_rows: int = 250, folder: str | None = None, late: str = "1 day",
) -> DataFrame:
    """(ent, t, base_rate_live) with a ring of the last h + window outcomes as state (NaN: unknown)."""

    def step(values: np.ndarray, old):
        ring, n, rate = (list(old[0]), old[1], old[2]) if old else ([], 0, fallback)
        seen = np.array([*ring, *values[:, 0]], float)
        rates = []
        for i in range(len(values)):
            if (n + i) % every == 0:
                upto = max(0, len(ring) + i - h)
                past = seen[max(0, upto - window) : upto]
                known = past[~np.isnan(past)]
                rate = float(known.mean()) if len(known) >= min_rows else rate
            rates.append(rate)
        return (rates,), (seen[-(h + window) :].tolist(), n + len(values), rate)

    return _in_order(stream, ent, t, "base_rate_live double", "ring array<double>, n long, rate double", [y], step, "rate", folder, late)


def stream_hmm_filter(stream: DataFrame, model: Hmm, columns: Sequence[str], ent: Sequence[str], t: str, folder: str | None = None, late: str = "1 day") -> DataFrame:
    """(ent, t, p_0..) with the last posterior of each entity as state. `columns` are scaled already."""

    def step(dens: np.ndarray, old):
        post = vec.hmm_forward(dens, model.start, model.trans, np.array(old[0], float) if old else None)
        return post.T.tolist(), (post[-1].tolist(),)

    return _in_order(
        stream, ent, t, ", ".join(f"p_{i} double" for i in range(len(model.start))), "alpha array<double>", list(columns), step, "hmm", folder, late,
        prepare=lambda x: vec.log_gauss(x, model.means, model.covs))
