"""Penalties on component block matrices and weights."""

from __future__ import annotations

import logging
import math
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import numpy as np

from mixlode.functions.gaussian import Component


log = logging.getLogger("mixlode.prior")


class Regularizer(ABC):
    """Extension point for other penalties."""

    @abstractmethod
    def component_gradient(self, c: Component) -> np.ndarray: ...

    @abstractmethod
    def weights_gradient(self, w: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def component_value(self, c: Component) -> float: ...

    @abstractmethod
    def weights_value(self, w: np.ndarray) -> float: ...


@dataclass(frozen=True)
class LogBarrier(Regularizer):
    """Keeps covariances away from singularity."""

    scale: float = 1.0

    def __post_init__(self) -> None:
        if not self.scale >= 1:
            raise ValueError("scale must be at least 1")

    def component_gradient(self, c):
        p = c.block()
        return self.scale * (p - np.outer(p[:, -1], p[:, -1]))

    def weights_gradient(self, w):
        return np.zeros_like(w)

    def component_value(self, c):
        return self.scale * (c.log_det + math.log(c.s) - c.s)

    def weights_value(self, w):
        return 0.0


@dataclass(frozen=True)
class ConjugatePrior(Regularizer):
    """Normal-inverse-Wishart prior on components, Dirichlet on weights."""

    dim: int
    k: int
    df: float | None = None
    mean: np.ndarray | None = None
    cov: np.ndarray | None = None
    dirichlet: float | None = None
    kappa: float = field(init=False)
    block: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if self.dim < 1 or self.k < 1:
            raise ValueError("dim and k must be positive")
        df = float(self.dim if self.df is None else self.df)
        mean = np.zeros(self.dim) if self.mean is None else np.array(self.mean, dtype=float)
        cov = np.eye(self.dim) if self.cov is None else np.array(self.cov, dtype=float)
        alpha = 1 / self.k if self.dirichlet is None else float(self.dirichlet)
        if not df > self.dim - 1 or not alpha > 0:
            raise ValueError("need df > dim - 1 and a positive Dirichlet parameter")
        if mean.shape != (self.dim,) or cov.shape != (self.dim, self.dim) or not (cov == cov.T).all():
            raise ValueError("mean and cov must match dim, and cov be symmetric")
        kappa = df + self.dim + 2
        edge = kappa * mean[:, None]
        block = np.block([[cov + edge @ mean[None, :], edge], [edge.T, np.array([[kappa]])]])
        for name, value in (("df", df), ("mean", mean), ("cov", cov), ("dirichlet", alpha), ("kappa", kappa), ("block", block)):
            object.__setattr__(self, name, value)
        log.info("prior of %d components in %d dimensions: df %g, kappa %g, Dirichlet %g", self.k, self.dim, df, kappa, alpha)

    def component_gradient(self, c):
        return 0.5 * (self.block - self.kappa * c.block())

    def weights_gradient(self, w):
        return self.dirichlet * (1 - self.k * w)

    def component_value(self, c):
        # both matrices are symmetric: the trace of the product is a plain sum
        return -0.5 * (self.kappa * (c.log_det + math.log(c.s)) + float((self.block * c.inverse_block()).sum()))

    def weights_value(self, w):
        return self.dirichlet * float(np.log(w).sum())
