"""Closed-form identities of components, regularizers, transforms and optimizers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mixlode import Adam, Adamax, Component, ConjugatePrior, GradientAscent, GradientMixture, LogBarrier, MixtureState, Momentum, Nesterov, RatioTransform, SoftmaxTransform
from mixlode.functions.gaussian import checked_weights
from mixlode.operators.sampling import batch_fraction, kmeans, ridge
from mixlode.operators.suffstats import fold
from mixlode.plans.mixture import update


def component(d: int, seed: int, s: float = 1.0) -> Component:
    """Eigenvalues between 0.3 and 3 in random directions."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    return Component(rng.normal(size=d), q @ np.diag(rng.uniform(0.3, 3, d)) @ q.T, s)


def pair() -> tuple[np.ndarray, tuple[Component, ...]]:
    return np.array([0.35, 0.65]), (Component([-1.5, 0.5], [[1.0, 0.2], [0.2, 0.8]]), Component([2.0, -0.5], [[1.5, -0.3], [-0.3, 1.0]]))


def slope_error(value, gradient: np.ndarray, c: Component, seed: int) -> float:
    """How far a gradient on block matrices is from the finite difference of a value along a random direction."""
    p = c.block()
    d = np.random.default_rng(seed).normal(size=p.shape)
    d, h = d + d.T, 1e-5
    numeric = (value(Component.from_block(p + h * d)) - value(Component.from_block(p - h * d))) / (2 * h)
    inverse = np.linalg.inv(p)
    exact = float(np.trace(inverse @ gradient @ inverse @ d))
    return abs(numeric - exact) / max(1.0, abs(exact))


def free_slopes(value, w: np.ndarray) -> np.ndarray:
    """Finite differences of a value of the weights, along each softmax parameter."""
    t, h = SoftmaxTransform(), 1e-6
    free = t.from_simplex(w)
    return np.array([(value(t.to_simplex(free + h * e)) - value(t.to_simplex(free - h * e))) / (2 * h) for e in np.eye(len(w))])


def test_statistics_are_gradients():
    w, comps = np.array([0.2, 0.5, 0.3]), tuple(component(2, seed, s) for seed, s in ((1, 1.0), (2, 0.7), (3, 1.4)))
    x = np.random.default_rng(8).normal(size=(37, 2))
    s = fold(x, w, comps)
    density = sum(v * c.concave_pdf(np.hstack([x, np.ones((37, 1))])) for v, c in zip(w, comps, strict=True))
    assert s.n == 37 and s.loss == pytest.approx(np.log(density).sum()) and s.resp.sum() == pytest.approx(37)
    for j, c in enumerate(comps):
        swapped = lambda new, j=j: fold(x, w, (*comps[:j], new, *comps[j + 1 :])).loss
        gradient = 0.5 * (s.outer[j] - s.resp[j] * c.block())
        assert slope_error(swapped, gradient, c, 20 + j) < 1e-6
        state, _ = update(MixtureState(w, comps), s, GradientAscent(learning_rate=0.05), None, 0.05)
        assert np.allclose(state.components[j].block(), c.block() + 0.05 * gradient / 37)
    assert np.allclose(free_slopes(lambda v: fold(x, v, comps).loss, w), s.weights_gradient(w), atol=1e-5)


@pytest.mark.parametrize("d", [1, 3, 12])
def test_component_identities(d):
    c = component(d, d)
    x = np.random.default_rng(1).normal(size=(4, d))
    lower = np.linalg.cholesky(c.sigma)
    z = np.linalg.solve(lower, (x - c.mu).T)
    expected = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(lower)).sum() - d / 2 * math.log(2 * math.pi)
    assert np.allclose(c.logpdf(x), expected) and np.allclose(c.pdf(x[0]), math.exp(expected[0]))
    assert c.log_det == pytest.approx(2 * np.log(np.diag(lower)).sum()) and c.det == pytest.approx(np.prod(np.diag(lower)) ** 2)
    assert np.allclose(np.linalg.inv(c.block()), c.inverse_block())
    again = Component.from_block(c.block())
    assert np.allclose(again.mu, c.mu) and np.allclose(again.sigma, c.sigma) and again.s == pytest.approx(1)
    assert np.allclose(c.concave_pdf(np.append(x[1], 1.0)), c.pdf(x[1]))


def test_scaled_component():
    c = Component([1.0], [[2.0]], 0.5)
    assert c.concave_pdf(np.array([1.0, 1.0])) == pytest.approx(c.pdf(np.array([1.0])) * math.exp(0.5 * (1 - 2)) / math.sqrt(0.5))


@pytest.mark.parametrize("bad", [dict(mu=[0.0], sigma=[[0.0]]), dict(mu=[0.0], sigma=[[-1.0]]), dict(mu=[0.0, 1.0], sigma=[[1.0]]), dict(mu=[0.0], sigma=[[1.0]], s=0.0), dict(mu=[np.nan], sigma=[[1.0]])])
def test_bad_components(bad):
    with pytest.raises(ValueError):
        Component(**bad)


@pytest.mark.parametrize("d,s", [(1, 1.0), (4, 0.6), (7, 1.8)])
def test_penalties_are_gradients(d, s):
    c, mean = component(d, 5, s), np.linspace(-1, 1, d)
    barrier, prior = LogBarrier(3.0), ConjugatePrior(d, 3, df=d + 2.5, mean=mean, cov=2 * np.eye(d), dirichlet=0.7)
    for penalty in (barrier, prior):
        assert slope_error(penalty.component_value, penalty.component_gradient(c), c, 6) < 1e-5
    w = np.array([0.2, 0.5, 0.3])
    assert np.allclose(free_slopes(prior.weights_value, w), prior.weights_gradient(w), atol=1e-6)
    assert barrier.weights_value(w) == 0 and not barrier.weights_gradient(w).any()
    assert barrier.component_value(c) == pytest.approx(3 * (np.linalg.slogdet(c.sigma)[1] + math.log(s) - s))


def test_penalties_are_checked():
    with pytest.raises(ValueError):
        LogBarrier(0.9)
    for bad in (dict(df=0.5), dict(dirichlet=0.0), dict(mean=[0.0]), dict(cov=[[1.0, 0.5], [0.0, 1.0]]), dict(dim=0)):
        with pytest.raises(ValueError):
            ConjugatePrior(**({"dim": 2, "k": 3} | bad))
    assert ConjugatePrior(4, 3).kappa == 4 + 4 + 2 and ConjugatePrior(4, 3).dirichlet == pytest.approx(1 / 3)


@given(st.lists(st.floats(0.01, 1.0), min_size=1, max_size=6))
@settings(max_examples=50, deadline=None)
def test_transforms_round_trip(raw):
    w = np.array(raw) / sum(raw)
    for t in (SoftmaxTransform(), RatioTransform()):
        assert np.allclose(t.to_simplex(t.from_simplex(w)), w)


def test_weights_are_checked():
    for bad in ([], [0.5, 0.6], [1.0, 0.0], [1.5, -0.5]):
        with pytest.raises(ValueError):
            checked_weights(bad)


def test_optimizers_by_hand():
    g, x = np.array([2.0]), np.array([1.0])
    assert GradientAscent().advance(x, g, 0.1, None, 0)[0] == pytest.approx(1.2)
    m = Momentum(beta=0.5)
    x1, slot = m.advance(x, g, 0.1, None, 0)
    assert m.advance(x1, g, 0.1, slot, 1)[0] == pytest.approx(1.2 + 0.1 * 3)
    n = Nesterov(gamma=0.5)
    x1, slot = n.advance(x, g, 0.1, None, 0)
    assert x1 == pytest.approx(1.5 * 1.2 - 0.5 * 1.0)
    assert n.advance(x1, g, 0.1, slot, 1)[0] == pytest.approx(1.5 * (x1 + 0.2) - 0.5 * 1.2)
    a, t = Adam(), 2.0
    scale = math.sqrt(1 - 0.1**t)
    assert a.advance(x, g, 0.1, None, 0)[0] == pytest.approx(1 + 0.1 * scale / (1 - 0.25) * 1.0 / (math.sqrt(0.9 * 4) + 1e-8 * scale))
    assert Adamax().advance(x, g, 0.1, None, 0)[0] == pytest.approx(1 + 0.1 * 2 / (2 + 1e-8) / (1 - 0.81))
    assert GradientAscent().halve_every(10).shrinkage == pytest.approx(2**-0.1)
    assert GradientAscent(learning_rate=0.001).shrunk(0.001) == 0.01
    for kind, bad in ((Momentum, dict(beta=1.0)), (Nesterov, dict(gamma=0.0)), (Adam, dict(eps=0.0)), (Adamax, dict(beta1=1.0)), (GradientAscent, dict(learning_rate=0.0))):
        with pytest.raises(ValueError):
            kind(**bad)


def test_sampling_scalars():
    assert batch_fraction(None, 10) == 1 and batch_fraction(50, 10) == 1 and batch_fraction(5, 0) == 1
    f = batch_fraction(1, 1000)
    assert (1 - f) ** 1000 <= 1.0001e-3
    assert np.allclose(ridge(np.zeros((4, 4))), np.eye(4) * 2.5e-5) and np.allclose(ridge(np.diag([1.0, 3.0])), np.diag([3.0, 5.0]))


def test_kmeans_finds_groups():
    rng = np.random.default_rng(11)
    at = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0], [9.0, 9.0]])
    x = np.vstack([rng.normal(c, 0.5, (60, 2)) for c in at])
    for seed in range(5):
        centers, cost = kmeans(x, 4, seed=seed)
        assert cost == pytest.approx(((x[:, None] - centers) ** 2).sum(axis=2).min(axis=1).sum())
    best = min((kmeans(x, 4, seed=i) for i in range(5)), key=lambda r: r[1])
    assert best[1] < 240 and sorted(np.round(best[0]).tolist()) == sorted(at.tolist())
    assert kmeans(x[:1].repeat(3, axis=0), 1)[1] == 0


def test_settings_are_checked_when_set():
    m = GradientMixture(MixtureState(*pair()), Momentum(), max_iter=2)
    for name, bad in (("max_iter", -1), ("tol", 0.0), ("batch_size", 0), ("optimizer", None), ("regularizer", 1), ("empty_retries", -1)):
        with pytest.raises(ValueError):
            setattr(m, name, bad)
    x = np.random.default_rng(4).normal(size=(30, 2))
    m.step_local(x)
    assert m.state.slots[0] is not None and m.state.clock
    m.optimizer = Momentum(beta=0.3)
    assert m.state.slots[0] is not None
    m.optimizer = Nesterov()
    assert m.state.slots == (None, None) and m.state.weights_slot is None and m.state.clock == 0
    m.max_iter, m.trace = 3, True
    m.step_local(x)
    assert len(m.trajectory) == 3 and m.state.clock and not np.allclose(m.trajectory[0][0], m.trajectory[2][0])
    assert m.reset_optimizer().state.clock == 0


def test_local_steps():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(-3, 1, (200, 2)), rng.normal(3, 1, (200, 2))])
    w, comps = pair()
    full = GradientMixture(MixtureState(w, comps), max_iter=30).step_local(x)
    losses = [h[2] for h in full.history]
    assert losses[-1] > losses[0] and all(b > a - 1e-9 for a, b in zip(losses, losses[1:], strict=False))
    batches = GradientMixture(MixtureState(w, comps), batch_size=50, max_iter=16).step_local(x)
    assert len(batches.history) == 16
    assert GradientMixture(MixtureState(w, comps)).step_local(np.zeros((0, 2))).history == []
    with pytest.raises(ValueError):
        GradientMixture(MixtureState(w, comps)).step_local([[np.nan, 0.0]])


def test_state_round_trip_and_scores():
    w, comps = pair()
    m = GradientMixture(MixtureState(w, comps), Momentum(), max_iter=3).step_local(np.random.default_rng(3).normal(size=(50, 2)))
    again = MixtureState.from_json(m.state.to_json())
    assert again.to_json() == m.state.to_json()
    assert m.predict_soft(np.array([1e9, 1e9])) == pytest.approx([0.5, 0.5])
    for bad in ([np.nan, 0.0], [0.0], [0.0, 1.0, 2.0], [np.inf, 0.0]):
        with pytest.raises(ValueError):
            m.predict_soft(np.array(bad))
    assert m.predict(np.array([1e9, 1e9])) == 0
    assert GradientMixture(MixtureState(w, comps)).predict(np.array([[-9.0, 0.0], [9.0, 0.0]])).tolist() == [0, 1]


def test_unstable_rules_raise():
    w, comps = pair()
    x = np.random.default_rng(5).normal(size=(100, 2))
    with pytest.raises(ValueError):
        GradientMixture(MixtureState(w, comps), Adam(learning_rate=5.0), max_iter=50).step_local(x)
