"""The mixture model: construct, seed, fit, step, score, export, save and load."""

from __future__ import annotations

import json
import logging
import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlode.functions.gaussian import Component, checked_weights, on_simplex
from mixlode.functions.optimizers import GradientAscent, Optimizer
from mixlode.functions.regularizers import Regularizer
from mixlode.operators import scoring
from mixlode.operators.sampling import batch_fraction, kmeans_seed, take_batch
from mixlode.operators.suffstats import Stats, fold, gather
from mixlode.sources.features import params_frame

log = logging.getLogger("mixlode.model")


@dataclass(frozen=True)
class MixtureState:
    """All that training changes; every step makes a new one."""

    weights: np.ndarray
    components: tuple[Component, ...]
    slots: tuple = ()
    weights_slot: tuple | None = None
    clock: int = 0
    batches: int = 0
    loss: float | None = None
    converged: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "weights", checked_weights(self.weights))
        object.__setattr__(self, "components", tuple(self.components))
        if len(self.weights) != len(self.components):
            raise ValueError("weights and components differ in number")
        if len({c.dim for c in self.components}) != 1:
            raise ValueError("components differ in dimension")
        if not self.slots:
            object.__setattr__(self, "slots", (None,) * len(self.components))

    def to_json(self) -> str:
        arrays = lambda slot: None if slot is None else [np.asarray(a).tolist() for a in slot]
        return json.dumps({
            "weights": self.weights.tolist(), "components": [[c.mu.tolist(), c.sigma.tolist(), c.s] for c in self.components], "slots": [arrays(s) for s in self.slots],
            "weights_slot": arrays(self.weights_slot), "clock": self.clock, "batches": self.batches, "loss": self.loss, "converged": self.converged,
        })

    @classmethod
    def from_json(cls, text: str) -> MixtureState:
        x = json.loads(text)
        arrays = lambda slot: None if slot is None else tuple(np.array(a) for a in slot)
        return cls(np.array(x["weights"]), tuple(Component(*c) for c in x["components"]), tuple(arrays(s) for s in x["slots"]), arrays(x["weights_slot"]), x["clock"], x["batches"], x["loss"], x["converged"])


def update(state: MixtureState, stats: Stats, optimizer: Optimizer, regularizer: Regularizer | None, rate: float) -> tuple[MixtureState, float]:
    """One ascent step from a batch's statistics; also the penalised mean log likelihood before it."""
    n, w, clock = stats.n, state.weights, state.clock
    penalty = sum(regularizer.component_value(c) for c in state.components) / n + regularizer.weights_value(w) / n if regularizer else 0.0
    components, slots = [], []
    for c, outer, slot in zip(state.components, stats.outer, state.slots, strict=True):
        block = c.block()
        gradient = 0.5 * (outer - outer[-1, -1] * block)
        if regularizer:
            gradient = gradient + regularizer.component_gradient(c)
        block, slot = optimizer.advance(block, gradient / n, rate, slot, clock)
        components.append(Component.from_block((block + block.T) / 2))
        slots.append(slot)
        clock += 1
    gradient = stats.weights_gradient(w)
    if regularizer:
        gradient = gradient + regularizer.weights_gradient(w)
    gradient = gradient / n
    gradient[-1] = 0.0
    free, weights_slot = optimizer.advance(optimizer.transform.from_simplex(w), gradient, rate, state.weights_slot, clock)
    weights = optimizer.transform.to_simplex(free)
    if not on_simplex(weights):
        raise ValueError("weights left the simplex; lower the learning rate")
    value = (stats.loss + penalty) / n
    return replace(state, weights=weights, components=tuple(components), slots=tuple(slots), weights_slot=weights_slot, clock=clock + 1, loss=value), value


#: What a setting must be, whenever it is assigned.
_SETTINGS = {
    "max_iter": (lambda v: v > 0, "max_iter must be positive"),
    "tol": (lambda v: v > 0, "tol must be positive"),
    "batch_size": (lambda v: v is None or v > 0, "batch_size must be positive"),
    "empty_retries": (lambda v: v >= 0, "empty_retries must not be negative"),
    "optimizer": (lambda v: isinstance(v, Optimizer), "optimizer must be an Optimizer"),
    "regularizer": (lambda v: v is None or isinstance(v, Regularizer), "regularizer must be a Regularizer"),
}


@dataclass
class GradientMixture:
    """Settings plus the current state.

    `history` has (iter, n, avg_loss, seconds) of the steps so far, and with `trace`
    set `trajectory` has the weights and components before each of them.  `sample_keys`:
    columns whose hash decides which rows a batch samples, see take_batch.
    """

    state: MixtureState
    optimizer: Optimizer = field(default_factory=GradientAscent)
    regularizer: Regularizer | None = None
    max_iter: int = 100
    tol: float = 1e-6
    batch_size: int | None = None
    sampling_seed: int = 0
    features: str = "features"
    empty_retries: int = 20
    sample_keys: tuple[str, ...] = ()
    trace: bool = False
    history: list[tuple[int, int, float, float]] = field(default_factory=list)
    trajectory: list[tuple[np.ndarray, tuple[Component, ...]]] = field(default_factory=list)

    def __setattr__(self, name: str, value) -> None:
        ok, message = _SETTINGS.get(name, (None, ""))
        if ok and not ok(value):
            raise ValueError(message)
        switched = name == "optimizer" and "state" in self.__dict__ and type(self.__dict__.get(name, value)) is not type(value)
        super().__setattr__(name, value)
        if switched:  # what one rule remembers means nothing to another
            self.reset_optimizer()

    def reset_optimizer(self) -> GradientMixture:
        """Forgets momentum, accelerator slots and the clock."""
        self.state = replace(self.state, slots=(), weights_slot=None, clock=0)
        return self

    # -- construction ------------------------------------------------------
    @classmethod
    def from_params(cls, weights, means, covs, **settings) -> GradientMixture:
        """From weights, means and covariances (arrays or Spark vectors and matrices)."""
        plain = lambda v: v.toArray() if hasattr(v, "toArray") else v
        return cls(MixtureState(np.asarray(weights, dtype=float), tuple(Component(plain(m), plain(c)) for m, c in zip(means, covs, strict=True))), **settings)

    @classmethod
    def init(cls, df: DataFrame, k: int, points_per_cluster: int = 50, kmeans_iter: int = 20, kmeans_tries: int = 1, seed: int = 0, **settings) -> GradientMixture:
        """Seeded by k-means on a sample."""
        weights, components = kmeans_seed(df, k, points_per_cluster, kmeans_iter, kmeans_tries, seed, settings.get("features", "features"), settings.get("sample_keys", ()))
        return cls(MixtureState(weights, tuple(components)), **settings)

    @classmethod
    def fit(cls, df: DataFrame, k: int, points_per_cluster: int = 50, kmeans_iter: int = 20, kmeans_tries: int = 1, seed: int = 0, **settings) -> GradientMixture:
        """init, then step.  `seed` goes to the seeding only; sampling_seed is that of the batches."""
        return cls.init(df, k, points_per_cluster, kmeans_iter, kmeans_tries, seed, **settings).step(df)

    # -- accessors ---------------------------------------------------------
    @property
    def k(self) -> int:
        return len(self.state.weights)

    @property
    def weights(self) -> np.ndarray:
        return self.state.weights

    @property
    def components(self) -> tuple[Component, ...]:
        return self.state.components

    @property
    def loss(self) -> float | None:
        return self.state.loss

    # -- training ----------------------------------------------------------
    def step(self, df: DataFrame) -> GradientMixture:
        """Up to max_iter ascent iterations on a DataFrame; empty input changes nothing."""
        data = df.select(self.features, *self.sample_keys).persist()
        try:
            fraction = 1.0 if self.batch_size is None else batch_fraction(self.batch_size, data.count())
            partitions = data.rdd.getNumPartitions()
            rate, new, old, iteration, empty = self.optimizer.learning_rate, 1.0, 0.0, 0, 0
            while iteration < self.max_iter and abs(new - old) > self.tol:
                began = time.time()
                s = self.state
                stats = gather(take_batch(data, fraction, self.sampling_seed + s.batches, self.sample_keys), s.weights, s.components, self.features, partitions)
                if not stats.n and fraction >= 1:  # no rows at all
                    return self
                self.state = s = replace(s, batches=s.batches + 1)
                if not stats.n:
                    empty += 1
                    if empty > self.empty_retries:
                        raise RuntimeError("samples stay empty; raise batch_size")
                    continue
                old = new
                self._traced()
                self.state, new = update(s, stats, self.optimizer, self.regularizer, rate)
                rate = self.optimizer.shrunk(rate)
                iteration += 1
                self.history.append((len(self.history), stats.n, new, time.time() - began))
                log.info("iteration %d: %d points, mean log likelihood %.9g, %.3f s", iteration, stats.n, new, self.history[-1][3])
            self.state = replace(self.state, converged=abs(new - old) <= self.tol)
            return self
        finally:
            data.unpersist()

    def _traced(self) -> None:
        if self.trace:
            self.trajectory.append((self.weights, self.components))
            log.debug("weights %s, means %s", self.weights.tolist(), [c.mu.tolist() for c in self.components])

    def step_local(self, points, shrink: bool = False) -> GradientMixture:
        """The same on a driver-side (n, d) array, in shuffled whole batches without Spark.

        max_iter updates at most; a trailing partial batch is left out of its epoch.
        """
        x = np.atleast_2d(np.asarray(points, dtype=float))
        if not x.size:
            return self
        if x.shape[1] != self.components[0].dim or not np.isfinite(x).all():
            raise ValueError("points must be finite and match the model's dimension")
        b = min(self.batch_size or len(x), len(x))
        rng, rate, last, done, order = np.random.default_rng(self.sampling_seed), self.optimizer.learning_rate, None, 0, np.arange(len(x))
        for epoch in range(math.ceil(b * self.max_iter / len(x)) if b < len(x) else self.max_iter):
            if epoch and b < len(x):
                order = rng.permutation(len(x))
            for i in range(len(x) // b):
                if done == self.max_iter:
                    return self
                began = time.time()
                s = self.state
                self._traced()
                self.state, value = update(replace(s, batches=s.batches + 1), fold(x[order[i * b : (i + 1) * b]], s.weights, s.components), self.optimizer, self.regularizer, rate)
                rate = self.optimizer.shrunk(rate) if shrink else rate
                done += 1
                self.history.append((len(self.history), b, value, time.time() - began))
                if last is not None and abs(value - last) < self.tol:
                    self.state = replace(self.state, converged=True)
                    return self
                last = value
        return self

    # -- scoring -----------------------------------------------------------
    def predict_soft(self, points):
        """Adds `probability` to a (batch or streaming) DataFrame; arrays give arrays."""
        if isinstance(points, DataFrame):
            return scoring.with_probability(points, self.weights, self.components, self.features)
        p = scoring.soft_local(points, self.weights, self.components)
        return p[0] if np.ndim(points) == 1 else p

    def predict(self, points):
        """Adds `prediction`, the first most probable component; arrays give ints."""
        if isinstance(points, DataFrame):
            return scoring.with_prediction(points, self.weights, self.components, self.features)
        p = self.predict_soft(points)
        return int(p.argmax()) if p.ndim == 1 else p.argmax(axis=1)

    # -- export ------------------------------------------------------------
    def params(self, spark: SparkSession) -> DataFrame:
        return params_frame(spark, self.weights, self.components)

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, n, float(v), s) for i, n, v, s in self.history], "iter int, n bigint, avg_loss double, seconds double")

    def trajectory_frame(self, spark: SparkSession) -> DataFrame:
        """The parameters before each traced iteration, a row for each component."""
        rows = [(i, j, float(w), c.s, c.mu.tolist(), c.sigma.tolist()) for i, (weights, comps) in enumerate(self.trajectory) for j, (w, c) in enumerate(zip(weights, comps, strict=True))]
        return spark.createDataFrame(rows, "iter int, component int, weight double, s double, mu array<double>, sigma array<array<double>>")

    def to_spark_gmm(self, spark: SparkSession):
        """A pyspark.ml GaussianMixtureModel with these parameters (s is dropped)."""
        from pyspark.ml.clustering import GaussianMixtureModel

        sc = spark.sparkContext
        jvm, gateway = sc._jvm, sc._gateway
        doubles = lambda v: _java_doubles(gateway, v)
        gaussians = gateway.new_array(jvm.org.apache.spark.ml.stat.distribution.MultivariateGaussian, self.k)
        for j, c in enumerate(self.components):
            gaussians[j] = jvm.org.apache.spark.ml.stat.distribution.MultivariateGaussian(jvm.org.apache.spark.ml.linalg.DenseVector(doubles(c.mu)), jvm.org.apache.spark.ml.linalg.DenseMatrix(c.dim, c.dim, doubles(c.sigma.ravel(order="F"))))
        return GaussianMixtureModel(jvm.org.apache.spark.ml.clustering.GaussianMixtureModel("mixlode", doubles(self.weights), gaussians))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the whole state, momentum included, as a one-row table."""
        spark.createDataFrame([(self.state.to_json(),)], "state string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **settings) -> GradientMixture:
        return cls(MixtureState.from_json(spark.read.parquet(path).select(F.col("state")).first()[0]), **settings)


def _java_doubles(gateway, values):
    out = gateway.new_array(gateway.jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out
