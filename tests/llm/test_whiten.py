"""Whitening: exact integer sums by brute force, numpy's covariance, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n int, x string, w int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "y", 3) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("low, high, n, d", [(99_000, 101_000, 300, 9), (-5, 6, 64, 3), (-(2**61), 2**61, 70, 3), (7, 8, 5, 2), (0, 2**40, 1, 4)])
def test_bit_planes_equal_integer_products(low, high, n, d):
    x = np.random.default_rng(3).integers(low, high, (n, d))
    sums, cross = whiten.cross_products(x)
    o = x.astype(object)
    assert list(sums) == list(o.sum(axis=0)) and (cross == o.T @ o).all()


def plain(vectors):
    """n, exact sums, covariance from exact fractions, eigenvalues and vectors."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / n**2 for j in range(d)] for i in range(d)])
    return x, n, s, v


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, n, s, v = plain([r["embedding"] for r in rows])
    values, vectors = np.linalg.eigh(v)
    got = whiten.op12_whiten(spark, SF).collect()
    assert len(got) == 8 * n and Counter(r["component"] for r in got) == {k: n for k in range(1, 9)}
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    for k in range(1, 9):
        e, q = values[-k], vectors[:, -k]
        want = (np.array(x, float) - np.array(s) / n) @ q / np.sqrt(e)
        have = np.array([by[r["vec_id"], k]["whitened"] for r in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert all(math.isclose(by[r["vec_id"], k]["explained"], e / np.trace(v), rel_tol=1e-9) for r in rows)
    for row, r in zip(x, rows):
        assert by[r["vec_id"], 1]["deviation"] == sum((n * c - t) ** 2 for c, t in zip(row, s)) and by[r["vec_id"], 8]["n"] == n


def test_odd_rows_are_left_out_and_repeated_ones_stay(spark):
    good = [(i, [float(i % 3), float(i % 5) * 2 - 3, i / 7]) for i in range(30)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [float("inf"), 1.0, 1.0]), (54, []), (55, [1.0, 2.0])]
    odd = [(None, [1.0, 2.0, 3.0]), (7, [0.5, -200.25, 30.0]), (7, [0.5, -200.25, 30.0])]
    got = whiten.whiten(frame(spark, good + bad + odd)).collect()
    x, n, s, v = plain([[np.float32(c) for c in vec] for _, vec in good + odd])
    assert Counter(r["vec_id"] for r in got) == Counter({i: 3 * k for i, k in Counter(i for i, _ in good + odd).items()})
    dev = Counter(sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x)
    assert Counter(r["deviation"] for r in got if r["component"] == 1) == dev
    assert all(r["n"] == n for r in got)


def test_no_variance_and_empty_tables(spark):
    same = [(i, [1.0, 2.0]) for i in range(4)]
    assert whiten.whiten(frame(spark, same)).count() == 0
    assert whiten.whiten(frame(spark, same).filter("vec_id < 0")).count() == 0
    far = [(i, [float(i % 3), 1e9 * (i % 2) + i]) for i in range(12)]  # sums beyond a long
    x, n, s, v = plain([vec for _, vec in far])
    got = whiten.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and all(r["deviation"] is None for r in got) and got[0]["identity_error"] < 1e-6
    line = [(i, [float(i), 2.0 * i]) for i in range(9)]  # one direction only
    got = whiten.whiten(frame(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)
