"""Gaussian mixtures by gradient ascent on Spark DataFrames and streams."""

from mixlode.functions.gaussian import Component
from mixlode.functions.optimizers import Adam, Adamax, GradientAscent, Momentum, Nesterov
from mixlode.functions.regularizers import ConjugatePrior, LogBarrier
from mixlode.functions.transforms import RatioTransform, SoftmaxTransform
from mixlode.plans.mixture import GradientMixture, MixtureState

__all__ = [
    "Adam", "Adamax", "Component", "ConjugatePrior", "GradientAscent", "GradientMixture", "LogBarrier",
    "MixtureState", "Momentum", "Nesterov", "RatioTransform", "SoftmaxTransform",
]
