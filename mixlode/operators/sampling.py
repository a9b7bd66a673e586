"""Batch sampling and k-means seeding."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlode.functions.gaussian import Component

#: Bits of a hash that make a uniform number; a double holds them all.
UNIFORM_BITS = 52


def digest(seed: int, keys: tuple[str, ...]) -> Column:
    """MD5 of the seed and the keys, in hexadecimal."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def batch_fraction(batch_size: int | None, total: int) -> float:
    """Fraction for a Bernoulli sample that is empty with probability 1e-3 at most."""
    if batch_size is None or total <= 0:
        return 1.0
    safe = total * (1 - math.exp(math.log(1e-3) / total))
    return min(max(batch_size, safe) / total, 1.0)


def take_batch(df: DataFrame, fraction: float, seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A Bernoulli sample.  With keys, a row is in it or not by their hash, however the rows are partitioned."""
    if fraction >= 1:
        return df
    if not keys:
        return df.sample(False, fraction, seed)
    u = F.conv(F.substring(digest(seed, keys), 1, UNIFORM_BITS // 4), 16, 10).cast("double") / F.lit(float(1 << UNIFORM_BITS))
    return df.where(u < fraction)


def take_sample(df: DataFrame, n: int, seed: int, features: str = "features", keys: tuple[str, ...] = ()) -> list[list[float]]:
    """n rows' features, chosen by a seeded order (a top-k plan, no full sort); with keys, by the order of their hash."""
    order = digest(seed, keys) if keys else F.rand(seed)
    return [r[0] for r in df.select(F.col(features), order.alias("__order")).orderBy("__order").limit(n).collect()]


def group_stats(df: DataFrame, centers: list, features: str = "features", label: str = "prediction") -> DataFrame:
    """Per label: count and the mean outer product about its fixed center, as c_ab (1-based)."""
    d = len(centers[0])
    at = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    dx = F.zip_with(F.col(features), F.element_at(at, F.col(label) + 1), lambda a, b: a - b)
    rows = df.select(label, dx.alias("dx"))
    x = F.col("dx")
    n = F.count(F.lit(1))
    cells = [(F.sum(x[a] * x[b]) / n).alias(f"c_{a + 1}{b + 1}") for a in range(d) for b in range(a, d)]
    return rows.groupBy(label).agg(n.alias("n"), *cells)


def ridge(cov: np.ndarray) -> np.ndarray:
    """A covariance with its seeding ridge: max(1e-4, trace) / d on the diagonal."""
    d = len(cov)
    return cov + np.eye(d) * max(1e-4, float(np.trace(cov))) / d


def uniforms(seed: int, draw: int, n: int) -> np.ndarray:
    """n numbers in (0, 1] by hash, the draw-th such row of numbers."""
    digits = (hashlib.md5(f"{seed}|{draw}|{i}".encode()).hexdigest()[: UNIFORM_BITS // 4] for i in range(n))
    return (np.array([int(x, 16) for x in digits], dtype=float) + 1) / (1 << UNIFORM_BITS)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def kmeans(x: np.ndarray, k: int, iterations: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Centers and cost of one run on a driver-side sample.

    Starts are drawn with probability in proportion to the squared distance from those
    drawn before: the point of least exponential number, divided by that distance.
    """
    centers = x[[np.argmin(-np.log(uniforms(seed, 0, len(x))))]]
    for draw in range(1, k):
        near = squared_distances(x, centers).min(axis=1)
        with np.errstate(divide="ignore"):
            centers = np.vstack([centers, x[np.argmin(np.where(near > 0, -np.log(uniforms(seed, draw, len(x))) / near, np.inf))]])
    label = None
    for _ in range(iterations):
        now = squared_distances(x, centers).argmin(axis=1)
        if label is not None and (now == label).all():
            break
        label = now
        centers = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centers[j] for j in range(k)])
    return centers, float(squared_distances(x, centers).min(axis=1).sum())


def kmeans_seed(
    df: DataFrame, k: int, points_per_cluster: int = 50, iterations: int = 20, tries: int = 1, seed: int = 0, features: str = "features", keys: tuple[str, ...] = ()
) -> tuple[np.ndarray, list[Component]]:
    """Weights and components from the best of `tries` k-means runs on a sample of at most k * points_per_cluster rows.

    The sample is on the driver, so all that follows is NumPy on a few rows.  keys: see take_sample.
    """
    if min(k, points_per_cluster, iterations, tries) < 1:
        raise ValueError("k, points_per_cluster, iterations and tries must be positive")
    rows = take_sample(df, k * points_per_cluster, seed, features, keys)
    if any(r is None or len(r) != len(rows[0]) or not np.isfinite(np.array(r, dtype=float)).all() for r in rows):
        raise ValueError("every point must have the same number of finite elements")
    if len({tuple(r) for r in rows}) < k:
        raise ValueError(f"the sample holds fewer than {k} distinct points")
    x = np.array(rows, dtype=float)
    centers, _ = min((kmeans(x, k, iterations, seed + i) for i in range(tries)), key=lambda run: run[1])
    seen = np.vstack([x, centers])  # the centers join the sample, so that no group is empty
    label = squared_distances(seen, centers).argmin(axis=1)
    counts = np.bincount(label, minlength=k)
    if not counts.all():
        raise ValueError(f"k-means found fewer than {k} distinct clusters")
    components = []
    for j, center in enumerate(centers):
        off = seen[label == j] - center
        components.append(Component(center, ridge(off.T @ off / counts[j])))
    return counts / counts.sum(), components
