"""One aggregation of the E-step's sufficient statistics per iteration.

`suffstats` is a plain aggregate of built-in expressions (small d, composes with
SQL).  `gather` is what training uses: every task folds its rows into one row
with matrix products, and those rows are merged in two levels where they are many,
so neither the driver nor a single task ever sees one row per input partition of a
large job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlode.operators.scoring import checked, joint, joint_local


@dataclass(frozen=True)
class Stats:
    """n points, summed log density, and per component the sum of r y y' (its corner is N_j)."""

    n: int
    loss: float
    outer: np.ndarray

    @property
    def resp(self) -> np.ndarray:
        return self.outer[:, -1, -1]

    def weights_gradient(self, weights: np.ndarray) -> np.ndarray:
        return self.resp - self.n * weights


def fold(x: np.ndarray, weights, components) -> Stats:
    """The statistics of an (n, d) array."""
    q = joint_local(x, weights, components, training=True)
    total = q.sum(axis=1)
    r = q / total[:, None]
    y = np.hstack([x, np.ones((len(x), 1))])
    return Stats(len(x), float(np.log(total).sum()), np.stack([(y * r[:, [j]]).T @ y for j in range(len(components))]))


def suffstats(df: DataFrame, weights, components, features: str = "features") -> DataFrame:
    """One row: n, loss, resp_j, wgrad_j and the upper triangle outer_j_ab (1-based); points that are not usable raise an error."""
    k, d = len(components), components[0].dim
    points = df.select(checked(features, d).alias("x"))
    q = points.select("x", *[c.alias(f"q{j}") for j, c in enumerate(joint(weights, components, True, "x"))])
    total = reduce(add, [F.col(f"q{j}") for j in range(k)])
    rows = q.select("x", F.log(total).alias("l"), *[(F.col(f"q{j}") / total).alias(f"r{j}") for j in range(k)])
    y = [*[F.get(F.col("x"), F.lit(i)) for i in range(d)], F.lit(1.0)]
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("l"), F.lit(0.0)).alias("loss")]
    for j in range(k):
        r = F.col(f"r{j}")
        sums += [F.sum(r).alias(f"resp_{j + 1}"), F.sum(r - F.lit(float(weights[j]))).alias(f"wgrad_{j + 1}")]
        sums += [F.sum(r * y[a] * y[b]).alias(f"outer_{j + 1}_{a + 1}{b + 1}") for a in range(d + 1) for b in range(a, d + 1)]
    return rows.agg(*sums)


#: Bytes of partial statistics that the driver merges by itself.
DIRECT_BYTES = 8 << 20
_PARTIAL = "n long, loss double, cells array<double>"


def _points(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    x = flat.to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    if column.null_count or (lengths != dim).any() or not np.isfinite(x).all():
        raise ValueError(f"every point must have {dim} finite elements")
    return x.reshape(-1, dim)


def gather(df: DataFrame, weights, components, features: str = "features", partitions: int | None = None) -> Stats:
    """The statistics of a DataFrame, for the driver.

    partitions: how many the DataFrame has, if known.  Where their rows make DIRECT_BYTES
    at most, they go to the driver as they are; else a second level merges them first.
    """
    k, d = len(components), components[0].dim
    shape = (k, d + 1, d + 1)

    def row(n: int, loss: float, cells: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "loss": pa.array([loss], pa.float64()), "cells": pa.array([cells.ravel().tolist()], pa.list_(pa.float64()))})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, cells = 0, 0.0, np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                s = fold(_points(batch.column(0), d), weights, components)
                n, loss, cells = n + s.n, loss + s.loss, cells + s.outer
        if n:
            yield row(n, loss, cells)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, cells = 0, 0.0, np.zeros(shape).ravel()
        for batch in batches:
            if batch.num_rows:
                n += sum(batch.column(0).to_pylist())
                loss += sum(batch.column(1).to_pylist())
                cells = cells + batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        if n:
            yield row(n, loss, cells)

    parts = df.select(F.col(features).cast("array<double>").alias("x")).mapInArrow(partial, _PARTIAL)
    if partitions is None or partitions * (math.prod(shape) + 2) * 8 > DIRECT_BYTES:
        width = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism * 4))
        parts = parts.repartition(width).mapInArrow(merge, _PARTIAL)
    got = parts.toArrow()
    if not got.num_rows:
        return Stats(0, 0.0, np.zeros(shape))
    cells = got["cells"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1).sum(axis=0)
    return Stats(sum(got["n"].to_pylist()), math.fsum(got["loss"].to_pylist()), cells.reshape(shape))
