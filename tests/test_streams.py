"""Streams whose files come out of order, and the change log of the upsert."""

import datetime as dt

import numpy as np
import pandas as pd

from tests.test_brute_force import written
from tidemark.operators import engines
from tidemark.streaming import jobs

ENT, T = ["ent"], "t"
MODEL = engines.Hmm(engines.Scaler(("x",), (0.0,), (0.0,), (1.0,)), np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([[0.0], [1.5]]), np.array([[[1.0]], [[0.5]]]))


def test_rows_out_of_order_give_what_sorted_rows_give(spark, tmp_path):
    g = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(e, start + dt.timedelta(hours=6 * i, microseconds=int(g.integers(0, 999))), float(v)) for e in ("p", "q") for i, v in enumerate(g.normal(0.7, 1, 160))]
    # a row comes up to two days late, in a later file
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=float(g.uniform(0, 47))))
    source, folder = tmp_path / "source", str(tmp_path / "state")
    schema = "ent string, t timestamp, z_x double"
    run = lambda: jobs.stream_hmm_filter(jobs.read_stream(spark, str(source), 1), MODEL, ["z_x"], ENT, T, folder=folder, late="2 days")
    want = lambda some: engines.hmm_filter(spark.createDataFrame(some, schema).withColumnRenamed("z_x", "x"), MODEL, ENT, T).orderBy("ent", "t").toPandas()
    for k in range(0, 160, 40):
        written(spark.createDataFrame(order[k : k + 40], schema), source, f"f{k // 40}")
    got = run().orderBy("ent", "t").toPandas()
    pd.testing.assert_frame_equal(got, want(order[:160]), check_exact=False, rtol=1e-9)
    for k in range(160, 320, 40):  # later files put rows before some that were given as the tail
        written(spark.createDataFrame(order[k : k + 40], schema), source, f"f{k // 40}")
    for _ in range(2):
        pd.testing.assert_frame_equal(run().orderBy("ent", "t").toPandas(), want(rows), check_exact=False, rtol=1e-9)
    written(spark.createDataFrame([("p", start, 9.0)], schema), source, "late")  # behind the watermark
    pd.testing.assert_frame_equal(run().orderBy("ent", "t").toPandas(), want(rows), check_exact=False, rtol=1e-9)


def test_upsert_writes_changes_and_merges_full_buckets_alone(spark, tmp_path):
    g = np.random.default_rng(4)
    source, folder = tmp_path / "source", tmp_path / "table"
    schema, state = "k long, ts timestamp, v double, w string", {}
    run = lambda: jobs.stream_upsert(jobs.read_stream(spark, str(source), 1), ["k"], "ts", folder=str(folder), buckets=4, compact=2)
    for i in range(7):
        keys = g.choice(30, 12, replace=False) if i % 2 else [3, 4]
        rows = [(int(k), dt.datetime(2024, 1, 1 + i), None if k % 5 == 0 else float(i), f"b{i}") for k in keys]
        state |= {r[0]: r for r in rows}
        written(spark.createDataFrame(rows, schema), source, f"f{i}")
        if i % 3 == 2 or i == 6:
            got = {tuple(r) for r in run().collect()}
            assert got == set(state.values())
    bases = [p.name for p in folder.glob("base/*/_bucket=*")]
    assert bases and len(bases) < 4 * len(list(folder.glob("base/*")))  # no base of all buckets each time
    assert len(list(folder.glob("log/*"))) == 7


def test_state_is_kept_per_bucket_of_entities(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 4)
    g = np.random.default_rng(6)
    big, start = 2**60 + 1, dt.datetime(2024, 1, 1)
    rows = [(None if e == 7 else big + e, None if e == 8 else f"s{e % 3}", start + dt.timedelta(hours=8 * i), float(g.integers(0, 2)) if i % 5 else None) for e in range(40) for i in range(30)]
    source, folder = tmp_path / "source", str(tmp_path / "state")
    df = spark.createDataFrame(rows, "a bigint, b string, t timestamp, y double")
    written(df.filter("t < '2024-01-05'"), source, "f0")
    run = lambda: jobs.stream_base_rate(jobs.read_stream(spark, str(source), 1), "y", 2, 0.5, ["a", "b"], "t", window=6, every=3, min_rows=2, folder=folder)
    run()
    written(df.filter("t >= '2024-01-05'"), source, "f1")
    out = run()
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "t": "timestamp", "base_rate_live": "double"}
    got = {tuple(r)[:3]: r["base_rate_live"] for r in out.collect()}
    want = {}
    for e in range(40):
        mine, rate = rows[30 * e : 30 * e + 30], 0.5
        for i, r in enumerate(mine):
            known = [q[3] for q in mine[max(0, i - 8) : max(0, i - 2)] if q[3] is not None]
            rate = sum(known) / len(known) if i % 3 == 0 and len(known) >= 2 else rate
            want[r[:3]] = rate
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    held = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "held").load()
    assert held.select("key").distinct().count() <= 4 and held.count() == 40


def test_waiting_rows_are_arrays_in_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    monkeypatch.setattr(jobs, "CHUNK", 50, raising=False)
    g = np.random.default_rng(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(None if e == 5 else e, start + dt.timedelta(hours=i, microseconds=int(g.integers(0, 999))), None if i % 7 == 3 else float(g.random())) for e in range(6) for i in range(90)]
    source, folder = tmp_path / "source", str(tmp_path / "state")
    files = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=float(g.uniform(0, 23))))
    for k in range(0, 540, 180):
        written(spark.createDataFrame(files[k : k + 180], "ent bigint, t timestamp, y double"), source, f"f{k // 180}")
    out = jobs.stream_base_rate(jobs.read_stream(spark, str(source), 1), "y", 2, 0.5, ENT, T, window=6, every=3, min_rows=2, folder=folder)
    got, want = {tuple(r)[:2]: r["base_rate_live"] for r in out.collect()}, {}
    for e in range(6):
        mine, rate = rows[90 * e : 90 * e + 90], 0.5
        for i, r in enumerate(mine):
            known = [q[2] for q in mine[max(0, i - 8) : max(0, i - 2)] if q[2] is not None]
            rate = sum(known) / len(known) if i % 3 == 0 and len(known) >= 2 else rate
            want[r[:2]] = rate
    assert out.count() == 540 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    waiting = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "rows").load().select("list_element.us")
    sizes = [len(us) if isinstance(us := r["us"], list) else 1 for r in waiting.collect()]
    assert 100 < sum(sizes) < 540 and max(sizes) <= 50 and len(sizes) < sum(sizes) / 10
