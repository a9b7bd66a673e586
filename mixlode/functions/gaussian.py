"""Gaussian components, their block-matrix codec and the weight simplex."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

#: Machine epsilon and the bounds of an unnormalised density.
EPS = float(np.finfo(float).eps)
TINY = 5e-324
HUGE = float(np.finfo(float).max)
LN_2PI = math.log(2 * math.pi)


def covariance_root(sigma: np.ndarray) -> tuple[np.ndarray, float]:
    """R and u with logpdf(x) = u - |R (x - mu)|^2 / 2.

    Directions whose eigenvalue is within rounding of zero are left out (a
    pseudo-inverse).  A negative eigenvalue beyond that, or rank 0, is an error.
    """
    values, vectors = np.linalg.eigh(sigma)
    top = float(values.max())
    if not top > 0:
        raise ValueError("covariance has no positive eigenvalue")
    tol = EPS * top * len(values)
    if float(values.min()) < -tol:
        raise ValueError(f"covariance is not positive semi-definite (eigenvalue {values.min():.3g})")
    keep = values > tol
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
    return scale[:, None] * vectors.T, -0.5 * (len(values) * LN_2PI + float(np.log(values[keep]).sum()))


@dataclass(frozen=True)
class Component:
    """One mixture component: scalar `s`, mean `mu`, covariance `sigma`."""

    mu: np.ndarray
    sigma: np.ndarray
    s: float = 1.0
    root: np.ndarray = field(init=False, repr=False, compare=False)
    log_norm: float = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        mu, sigma = np.array(self.mu, dtype=float), np.array(self.sigma, dtype=float)
        if mu.ndim != 1 or sigma.shape != (len(mu), len(mu)):
            raise ValueError("sigma must be square and match mu")
        if not (np.isfinite(mu).all() and np.isfinite(sigma).all()):
            raise ValueError("component parameters must be finite")
        if not self.s > 0:
            raise ValueError("s must be positive")
        root, log_norm = covariance_root(sigma)
        for name, value in (("mu", mu), ("sigma", sigma), ("root", root), ("log_norm", log_norm)):
            object.__setattr__(self, name, value)

    @classmethod
    def from_block(cls, block: np.ndarray) -> Component:
        """The component whose block matrix this is."""
        s = float(block[-1, -1])
        if not s > 0:
            raise ValueError("s left the positive axis; lower the learning rate")
        mu = block[:-1, -1] / s
        return cls(mu, block[:-1, :-1] - s * np.outer(mu, mu), s)

    @classmethod
    def from_spark(cls, gaussian) -> Component:
        """From a pyspark.ml or pyspark.mllib MultivariateGaussian-like object."""
        mean = getattr(gaussian, "mean", getattr(gaussian, "mu", None))
        cov = getattr(gaussian, "cov", getattr(gaussian, "sigma", None))
        return cls(mean.toArray(), cov.toArray())

    @property
    def dim(self) -> int:
        return len(self.mu)

    def logpdf(self, x: np.ndarray) -> np.ndarray:
        """Log density of one point (d,) or of many (n, d)."""
        z = (np.asarray(x, dtype=float) - self.mu) @ self.root.T
        return self.log_norm - 0.5 * (z * z).sum(axis=-1)

    def pdf(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self.logpdf(x))

    @property
    def log_concave_offset(self) -> float:
        """What the training density adds to logpdf; 0 at s = 1."""
        return 0.5 * (1 - 1 / self.s) - 0.5 * math.log(self.s)

    def concave_pdf(self, y: np.ndarray) -> np.ndarray:
        """Training density of augmented points [x 1]."""
        return np.exp(self.logpdf(np.asarray(y)[..., :-1]) + self.log_concave_offset)

    @property
    def log_det(self) -> float:
        return -2 * self.log_norm - self.dim * LN_2PI

    @property
    def det(self) -> float:
        return math.exp(self.log_det)

    def block(self) -> np.ndarray:
        """[[sigma + s mu mu', s mu], [s mu', s]]."""
        edge = self.s * self.mu[:, None]
        return np.block([[self.sigma + edge @ self.mu[None, :], edge], [edge.T, np.array([[self.s]])]])

    def inverse_block(self) -> np.ndarray:
        inverse = self.root.T @ self.root
        edge = -(inverse @ self.mu)[:, None]
        corner = 1 / self.s + float(self.mu @ inverse @ self.mu)
        return np.block([[inverse, edge], [edge.T, np.array([[corner]])]])


def on_simplex(weights: np.ndarray) -> bool:
    """Whether the weights sum to 1 within 1e-4."""
    return bool((np.sum(weights) - 1) ** 2 <= 1e-8)


def checked_weights(weights) -> np.ndarray:
    """The weights as an array; they must be positive and sum to 1."""
    w = np.array(weights, dtype=float)
    if w.ndim != 1 or not len(w) or not (w > 0).all() or not on_simplex(w):
        raise ValueError("weights must be positive and sum to 1")
    return w
