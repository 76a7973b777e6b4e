"""Principal components of vectors, from moments that the tasks add up, and similarity of centroids over time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import ship

#: Most numbers in a vector, as the moments are a square of it; turns of the iteration, and what it has to settle to.
MOST, TURNS, SETTLED = 4096, 2000, 1e-13


def moments(rows: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of an array column; null arrays are passed over. A task gives a row for each number of a vector."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for b in batches:
            lists = b.column(0).drop_null()
            if len(lists):
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
                n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            wide = np.concatenate([np.full((len(total), 1), float(n)), total[:, None], square], axis=1)
            ends = pa.array(np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wide), dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(wide.ravel()))], names=["i", "v"])

    each = rows.select(F.col(column).cast("array<double>")).mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x"))
    found = each.groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    if not found.num_rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    i, j, x = (found.column(c).to_numpy() for c in ("i", "j", "x"))
    if i.max() >= MOST:
        raise ValueError(f"vectors of over {MOST} numbers")
    wide = np.zeros((i.max() + 1, j.max() + 1))
    wide[i, j] = x
    n = int(wide[0, 0])
    mean = wide[:, 1] / n
    return n, mean, wide[:, 2:] / n - np.outer(mean, mean)


def leading(square: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, and its vectors as rows: orthogonal iteration with Gram-Schmidt.

    A vector's largest number is positive, so signs are fixed.
    """
    k = min(k, len(square))
    q = np.random.default_rng(0).normal(size=(k + min(4, len(square) - k), len(square)))  # some more settle the last one sooner
    before = None
    for _ in range(TURNS):
        q = q @ square
        for i in range(len(q)):
            for _ in range(2):  # a second time for what rounding leaves
                q[i] -= (q[:i] @ q[i]) @ q[:i]
            size = np.sqrt(q[i] @ q[i])
            q[i] = q[i] / size if size > 1e-12 * max(1.0, np.abs(square).max()) else 0.0
        values = np.einsum("ij,ij->i", q @ square, q)
        if before is not None and np.abs(values - before)[:k].max(initial=0.0) <= SETTLED * max(1e-300, np.abs(values).max(initial=0.0)):
            break
        before = values
    # In the space that was found, turn by plane rotations to the axes themselves.
    small = q @ square @ q.T
    turn = np.eye(len(q))
    for _ in range(60):
        off = np.abs(small - np.diag(np.diag(small)))
        if off.max(initial=0.0) <= 1e-15 * max(1e-300, np.abs(small).max(initial=0.0)):
            break
        for a in range(len(q)):
            for b in range(a + 1, len(q)):
                if abs(small[a, b]) > 0:
                    angle = 0.5 * np.arctan2(2 * small[a, b], small[a, a] - small[b, b])
                    c, s = np.cos(angle), np.sin(angle)
                    r = np.eye(len(q))
                    r[a, a], r[a, b], r[b, a], r[b, b] = c, s, -s, c
                    small, turn = r @ small @ r.T, r @ turn
    order = np.argsort(-np.diag(small), kind="stable")[:k]
    vectors = (turn @ q)[order]
    for v in vectors:
        v *= -1 if v[np.abs(v).argmax()] < 0 else 1
    return np.diag(small)[order], vectors


@dataclass
class Components:
    """Mean, variances and directions (as rows), largest variance first, and the sum of all variances."""

    mean: np.ndarray
    variances: np.ndarray
    vectors: np.ndarray
    total: float

    @staticmethod
    def fit(rows: DataFrame, column: str, k: int = 2) -> Components:
        _, mean, square = moments(rows, column)
        values, vectors = leading(square, k)
        return Components(mean, values, vectors, float(np.trace(square)))

    def project(self, column: Column) -> Column:
        """An array with the vector's place on each component."""
        shift = [float(x) for x in self.vectors @ self.mean] if len(self.vectors) else []
        dot = lambda v: F.aggregate(F.zip_with(column, F.array(*(F.lit(float(x)) for x in v)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.array(*(dot(v) - F.lit(s) for v, s in zip(self.vectors, shift, strict=True)))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the two is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, n, centroid): means of the vectors of each group, number by number, so a group of any size is combined before the shuffle."""
    each = rows.select(*by, F.posexplode(column).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_x"), F.count(F.lit(1)).alias("n"))
    lists = each.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_c"))
    return lists.select(*by, "n", F.col("_c._x").alias("centroid"))


def over_time(groups: DataFrame, by: list[str], period: str) -> DataFrame:
    """(by, period, next_period, similarity): the cosine of each centroid and the next one in time of its group; there are as many rows as periods."""
    order = Window.partitionBy(*by).orderBy(period)
    out = groups.withColumn("next_period", F.lead(period).over(order)).withColumn("_next", F.lead("centroid").over(order))
    return out.where("next_period is not null").select(*by, period, "next_period", cosine(F.col("centroid"), F.col("_next")).alias("similarity"))
