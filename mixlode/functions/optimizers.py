"""Ascent rules.  Settings live here; momentum and clocks live in the model state.

A rule's `advance(x, g, rate, slot, clock)` returns the next value and the next
slot.  Slots are per parameter (None at first); `clock` is the count of earlier
`advance` calls of a whole model, shared by its parameters.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace

import numpy as np

from mixlode.functions.transforms import SoftmaxTransform, WeightTransform


@dataclass(frozen=True)
class Optimizer(ABC):
    learning_rate: float = 0.9
    min_learning_rate: float = 1e-2
    shrinkage: float = 2 ** (-1 / 20)
    transform: WeightTransform = field(default_factory=SoftmaxTransform)

    def __post_init__(self) -> None:
        if not self.learning_rate > 0 or not self.min_learning_rate >= 0 or not 0 < self.shrinkage <= 1:
            raise ValueError("need learning_rate > 0, min_learning_rate >= 0 and 0 < shrinkage <= 1")

    def shrunk(self, rate: float) -> float:
        """The rate of the next iteration."""
        return max(self.shrinkage * rate, self.min_learning_rate)

    def halve_every(self, iterations: float) -> Optimizer:
        """A copy whose rate halves in so many iterations."""
        if not iterations > 0:
            raise ValueError("iterations must be positive")
        return replace(self, shrinkage=2 ** (-1 / iterations))

    def advance(self, x, g, rate, slot, clock):
        step, slot = self.direction(g, slot, clock)
        return x + rate * step, slot

    @abstractmethod
    def direction(self, g, slot, clock):
        """The ascent direction for gradient g, and the next slot."""


@dataclass(frozen=True)
class GradientAscent(Optimizer):
    def direction(self, g, slot, clock):
        return g, None


@dataclass(frozen=True)
class Momentum(Optimizer):
    beta: float = 0.55

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 0 < self.beta < 1:
            raise ValueError("beta must lie in (0, 1)")

    def direction(self, g, slot, clock):
        m = g if slot is None else self.beta * slot[0] + g
        return m, (m,)


@dataclass(frozen=True)
class Nesterov(Optimizer):
    gamma: float = 0.6

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 0 < self.gamma < 1:
            raise ValueError("gamma must lie in (0, 1)")

    def direction(self, g, slot, clock):
        return g, slot

    def advance(self, x, g, rate, slot, clock):
        ahead = x + rate * g
        before = x if slot is None else slot[0]
        return (1 + self.gamma) * ahead - self.gamma * before, (ahead,)


@dataclass(frozen=True)
class Adam(Optimizer):
    beta1: float = 0.5
    beta2: float = 0.1
    eps: float = 1e-8

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 0 <= self.beta1 < 1 or not 0 <= self.beta2 < 1 or not self.eps > 0:
            raise ValueError("betas must lie in [0, 1) and eps be positive")

    def direction(self, g, slot, clock):
        t = clock + 2.0  # the clock of a fresh model counts from 1, and moves before use
        m0, v0 = slot or (np.zeros_like(g), np.zeros_like(g))
        m, v = self.beta1 * m0 + (1 - self.beta1) * g, self.beta2 * v0 + (1 - self.beta2) * g * g
        scale = math.sqrt(1 - self.beta2**t)
        return scale / (1 - self.beta1**t) * m / (np.sqrt(v) + self.eps * scale), (m, v)


@dataclass(frozen=True)
class Adamax(Optimizer):
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 0 <= self.beta1 < 1 or not 0 <= self.beta2 < 1 or not self.eps > 0:
            raise ValueError("betas must lie in [0, 1) and eps be positive")

    def direction(self, g, slot, clock):
        t = clock + 2.0
        m0, u0 = slot or (np.zeros_like(g), np.zeros_like(g))
        m, u = self.beta1 * m0 + g, np.maximum(self.beta2 * u0, np.abs(g))
        return m / (u + self.eps) / (1 - self.beta1**t), (m, u)
