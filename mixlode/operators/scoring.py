"""Densities, responsibilities and labels as columns.

Up to EXPRESSION_TERMS multiplications per row the formulas are unrolled into
built-in expressions, which stay in one codegen stage; beyond that an
Arrow-batched function does the same with matrix products.

A point is usable if it has as many elements as the model has dimensions, none of
them null, NaN or infinite.  On either path any other point has a null probability
and a null label; training and sufficient statistics raise an error for it, and so
does a local array that holds one.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlode.functions.gaussian import HUGE, TINY, Component

EXPRESSION_TERMS = 256


def usable(features: str, dim: int) -> Column:
    """Whether a point can be scored; an unrolled condition, never null."""
    x = F.col(features)
    finite = [F.abs(F.get(x, F.lit(i))) < F.lit(float("inf")) for i in range(dim)]  # NaN is above infinity
    return F.coalesce(reduce(and_, finite, F.size(x) == dim), F.lit(False))


def checked(features: str, dim: int) -> Column:
    """The point, or an error if it is not usable."""
    return F.when(usable(features, dim), F.col(features)).otherwise(F.raise_error(F.lit(f"every point must have {dim} finite elements")))


def logpdf(component: Component, features: str = "features") -> Column:
    """Log density as an expression."""
    x = F.col(features)
    centred = [F.get(x, F.lit(i)) - F.lit(float(m)) for i, m in enumerate(component.mu)]
    total = F.lit(0.0)
    for row in component.root:
        z = reduce(add, [F.lit(float(r)) * c for r, c in zip(row, centred, strict=True)])
        total = total + z * z
    return F.lit(component.log_norm) - F.lit(0.5) * total


def concave_pdf(component: Component, features: str = "features") -> Column:
    """Training density of [x 1] as an expression."""
    return F.exp(logpdf(component, features) + F.lit(component.log_concave_offset))


def clamp(q: Column, k: int) -> Column:
    return F.greatest(F.least(q, F.lit(HUGE / k)), F.lit(TINY))


def joint(weights, components, training: bool, features: str = "features") -> list[Column]:
    """Clamped w_j * density_j, with the training or the plain density."""
    density = concave_pdf if training else (lambda c, f: F.exp(logpdf(c, f)))
    return [clamp(F.lit(float(w)) * density(c, features), len(components)) for w, c in zip(weights, components, strict=True)]


def joint_local(x: np.ndarray, weights, components, training: bool) -> np.ndarray:
    """The same for an (n, d) array: (n, k)."""
    cols = [w * np.exp(c.logpdf(x) + (c.log_concave_offset if training else 0.0)) for w, c in zip(weights, components, strict=True)]
    # as greatest and least do, fmin and fmax pass over an undefined product
    return np.fmax(np.fmin(np.stack(cols, axis=1), HUGE / len(components)), TINY)


def soft_local(x: np.ndarray, weights, components) -> np.ndarray:
    x = np.atleast_2d(np.asarray(x, dtype=float))
    if x.ndim != 2 or x.shape[1] != components[0].dim or not np.isfinite(x).all():
        raise ValueError(f"every point must have {components[0].dim} finite elements")
    q = joint_local(x, weights, components, training=False)
    return q / q.sum(axis=1, keepdims=True)


def with_probability(df: DataFrame, weights, components, features: str = "features", name: str = "probability") -> DataFrame:
    """Adds soft labels: array<double> of k probabilities, null for points that are not usable."""
    k, d = len(components), components[0].dim
    if k * d * d <= EXPRESSION_TERMS:
        q = joint(weights, components, False, features)
        raw = df.withColumn(name, F.when(usable(features, d), F.array(*q)))
        total = reduce(add, [F.get(F.col(name), F.lit(j)) for j in range(k)])
        return raw.withColumn(name, F.when(F.col(name).isNotNull(), F.array(*[F.get(F.col(name), F.lit(j)) / total for j in range(k)])))

    @F.pandas_udf("array<double>")
    def soft(points: pd.Series) -> pd.Series:
        rows = points.tolist()
        fits = np.array([r is not None and len(r) == d for r in rows], dtype=bool)
        x = np.array([r for r, ok in zip(rows, fits, strict=True) if ok], dtype=float).reshape(-1, d)
        finite = np.isfinite(x).all(axis=1)
        out = np.full(len(rows), None, dtype=object)
        at = np.flatnonzero(fits)[finite]
        for i, p in zip(at, soft_local(x[finite], weights, components) if len(at) else [], strict=True):
            out[i] = p
        return pd.Series(out, dtype=object)

    return df.withColumn(name, soft(features))


def label_of(probability: str | Column = "probability") -> Column:
    """Index of the first greatest probability; null for null."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def with_prediction(df: DataFrame, weights, components, features: str = "features", name: str = "prediction") -> DataFrame:
    """Adds hard labels: int."""
    held = "__probability"
    return with_probability(df, weights, components, features, held).withColumn(name, label_of(held)).drop(held)
