"""Whitening of embeddings from exact integer cross-products, counted in bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize

# Fixed values of the integer grid, and the components that the query returns.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Grid values beyond +-2^62 are held there.
EDGE = 2**62
#: Base of the digits in which exact sums leave a task: sums of digits over 2^31 tasks fit a long.
LIMB = 32
#: A component with less than this share of the largest variance (times the dimensions) can't be told from rounding to 1 in 10,000.
RESOLVED = 2.0**-40
#: Rows whose planes a task holds at once.
ROWS = 8_192


def grid(vector: Column) -> Column:
    """Array of longs floor(1024 c) + 100000."""
    cell = lambda c: F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(c.cast("double") * SCALE))) + OFFSET
    return F.transform(vector, cell)


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of usable rows: no null, no null or non-finite entry, and the table's usual length.

    Vectors of another length than most (of equal counts the longest) can't be in one matrix and are left out.
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.forall("v", entry) & (F.size("v") > 0))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    return rows.filter(F.size("v") == (usual["d"] if usual else 0)).select("vec_id", grid(F.col("v")).alias("x"))


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of the columns of a long matrix, exact, as Python integers.

    Each column less its minimum is cut into bit planes and each plane packed over the rows
    into 64-bit words; the number of ones in the AND of plane a of one column and plane b of
    another, times 2^(a+b), is their share of the cross-product.
    """
    n, d = x.shape
    low = x.min(axis=0)
    y = (x - low).astype(np.uint64)
    bits = [int(v).bit_length() for v in y.max(axis=0)]
    dim = np.repeat(np.arange(d), bits)
    power = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if dim.size else np.zeros(0, np.int64)
    words = -(-n // 64)
    planes = np.zeros((len(dim), words * 8), np.uint8)
    for p, (i, b) in enumerate(zip(dim, power)):
        packed = np.packbits((y[:, i] >> np.uint64(b) & np.uint64(1)).astype(np.uint8))
        planes[p, : len(packed)] = packed
    planes = planes.view(np.uint64)
    ones = np.zeros((len(dim), len(dim)), np.int64)
    for p in range(len(dim)):
        ones[p, p:] = ones[p:, p] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    kind = np.int64 if n and 2 * max(bits, default=0) + n.bit_length() < 62 else object
    weight = np.zeros((d, len(dim)), kind)
    weight[dim, np.arange(len(dim))] = [1 << int(b) for b in power]
    shifted = (weight @ ones.astype(kind) @ weight.T).astype(object)
    own = (weight @ np.diagonal(ones).astype(kind)).astype(object)  # a plane's ones weigh 2^b in the sum
    m = low.astype(object)
    sums = own + n * m
    return sums, shifted + np.outer(m, own) + np.outer(own, m) + n * np.outer(m, m)


@dataclass(frozen=True)
class Whitening:
    """Exact n and sums, and the leading components: eigenvalues (falling), unit vectors in columns, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of a long matrix."""
        return self.centred(x) / self.n @ (self.vectors / np.sqrt(self.values))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact as longs where these suffice, else as Python integers; as doubles for the product."""
        return self._scaled(x).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squares of n x - S per row; None beyond a long."""
        far = self._scaled(x)
        if far.dtype != object and len(far) and len(self.sums) * int(np.abs(far).max()) ** 2 >= 2**63:
            far = far.astype(object)
        return [int(v) if v < 2**63 else None for v in (far * far).sum(axis=1)]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        wide = self.n * max([int(np.abs(x).max(initial=0)), 1]) + max(map(abs, self.sums), default=0) >= 2**63
        return x.astype(object) * self.n - np.array(self.sums, object) if wide else x * np.int64(self.n) - np.array(self.sums, np.int64)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Covariance of all rows of `rows` (x) and its leading components; None without rows.

    Tasks add up Python integers and emit base-2^32 digits, which Spark sums by matrix cell;
    d x d numbers reach the driver. Components without variance (all vectors equal, or fewer
    independent directions than asked for) or below RESOLVED are left out.
    """
    head = rows.select(F.size("x").alias("d")).first()
    if head is None:
        return None
    d = head["d"]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = matrix_of(batch.column(0), d)
            for at in range(0, len(x), ROWS):
                s, c = cross_products(x[at : at + ROWS])
                n, total, cross = n + len(x[at : at + ROWS]), total + s, cross + c
        cells = [n, *total, *cross[np.triu_indices(d)]]
        out: list[tuple[int, int, int]] = []
        for i, v in enumerate(cells):
            sign, left, k = (-1 if v < 0 else 1), abs(v), 0
            while left:
                out.append((i, k, sign * (left & (2**LIMB - 1))))
                left, k = left >> LIMB, k + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64()))], names=["i", "k", "v"])

    cells = [0] * (1 + d + d * (d + 1) // 2)
    for r in rows.select("x").mapInArrow(totals, "i int, k int, v bigint").groupBy("i", "k").agg(F.sum("v").alias("v")).collect():
        cells[r["i"]] += r["v"] << (LIMB * r["k"])
    n, sums = cells[0], cells[1 : 1 + d]
    v = np.zeros((d, d))
    for i, j, c in zip(*np.triu_indices(d), cells[1 + d :]):
        v[i, j] = v[j, i] = (n * c - sums[i] * sums[j]) / (n * n)  # integers up to here: one rounding
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)  # the largest entry is positive
    take = min(components, int((values > max(values[0], 0.0) * d * RESOLVED).sum()))
    return Whitening(n, tuple(sums), values[:take], vectors[:, :take], float(np.trace(v)))


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Every usable row is in the fit. identity_error is measured on the whitened rows, centred
    before they are multiplied. Repeated rows and ids, null ids too, each give their rows. A
    deviation beyond a long is null. Nothing comes from an empty table, or where all vectors are equal.
    """
    rows = materialize(clean_vectors(df, id_col, vector_col), "grid")
    model = fit_whitening(rows, components)
    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"
    k = len(model.values) if model else 0
    if not k:
        return df.sparkSession.createDataFrame([], f"{out}, identity_error double")
    d = len(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(1), d)
            w = np.ascontiguousarray(model.project(x))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) * k + 1, k), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviation(x), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    done = materialize(rows.select("vec_id", "x").mapInArrow(project, "vec_id bigint, deviation bigint, w array<double>"), "whitened")
    at = [F.col("w")[i] for i in range(k)]
    mean = done.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)]).first()
    apart = [c - mean[f"m{i}"] for i, c in enumerate(at)]
    cov = done.agg(*[F.avg(apart[i] * apart[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return done.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
