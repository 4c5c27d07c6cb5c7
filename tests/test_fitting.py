"""The batched solver against closed forms, dense searches and fits of one series alone."""

import math

import numpy as np
import pytest

from verdance.operators import fitting, growth

T = np.linspace(0, 20, 60)
TRUE = {"linear": [3.0, 2.0], "sqrt": [4.0], "sqrt_lag": [4.0, 2.3], "power": [3.0, 0.6], "logistic": [80.0, 0.6, 9.0], "gompertz": [70.0, 9.0, 4.0], "richards": [75.0, 0.7, 9.0, 1.4]}


def noisy(name, seed, n=60, phi=0.0, sd=0.5):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 20, n)) if n != 60 else T
    e = rng.normal(0, sd, n)
    for i in range(1, n):
        e[i] = phi * e[i - 1] + math.sqrt(1 - phi * phi) * e[i]
    return t, growth.MODELS[name].value(t, *TRUE[name]) + e


@pytest.mark.parametrize("name", sorted(TRUE))
@pytest.mark.parametrize("errors", ["iid", "ar1"])
def test_side_by_side_is_as_alone(name, errors):
    """Series of 12 to 90 points, weighted and not, padded to one batch."""
    model, each = growth.MODELS[name], [noisy(name, k, n) for k, n in enumerate((12, 25, 60, 90, 40, 13))]
    sigmas = [None if k % 2 else np.full(len(t), 0.5) for k, (t, _) in enumerate(each)]
    s = fitting.Series.of([t for t, _ in each], [y for _, y in each], sigmas)
    starts = np.array([model.start(t, y) for t, y in each], float)
    many = growth.fit_many(s, model.law(), model.params, starts, np.array([w is not None for w in sigmas]), errors)
    for got, (t, y), w in zip(many, each, sigmas):
        alone = growth.fit_one(t, y, w, name, errors)
        assert got["ok"] == alone["ok"] and got["n"] == len(t) and got["weighted"] == (w is not None)
        if got["ok"]:
            assert got["aic"] == pytest.approx(alone["aic"], abs=1e-4) and got["ar1_phi"] == pytest.approx(alone["ar1_phi"], abs=1e-2)


@pytest.mark.parametrize("name", sorted(TRUE))
def test_no_nearby_parameters_are_better(name):
    model = growth.MODELS[name]
    for seed in range(4):
        t, y = noisy(name, seed)
        fit = growth.fit_one(t, y, None, name)
        assert fit["ok"], fit
        q = np.array(list(fit["params"].values()))
        assert model.value(t, *q) == pytest.approx(model.value(t, *TRUE[name]), abs=1.5)
        best = ((y - model.value(t, *q)) ** 2).sum()
        assert fit["rmse"] == pytest.approx(math.sqrt(best / 60))
        rng = np.random.default_rng(9)
        for size in (1e-2, 1e-4):
            for _ in range(200):
                near = q * (1 + size * rng.normal(size=len(q)))
                assert ((y - model.value(t, *near)) ** 2).sum() >= best * (1 - 1e-9)


def test_standard_errors_are_the_analytic_ones():
    t, y = noisy("linear", 1)
    fit = growth.fit_one(t, y, None, "linear")
    a, b = fit["params"]["a"], fit["params"]["b"]
    s2 = ((y - a - b * t) ** 2).sum() / 58
    sxx = ((t - t.mean()) ** 2).sum()
    assert b == pytest.approx(((t - t.mean()) * y).sum() / sxx) and fit["stderr"]["b"] == pytest.approx(math.sqrt(s2 / sxx), rel=1e-6)
    assert fit["stderr"]["a"] == pytest.approx(math.sqrt(s2 * (1 / 60 + t.mean() ** 2 / sxx)), rel=1e-6)
    for unc in (None, np.linspace(0.2, 0.9, 60)):
        t, y = noisy("logistic", 2)
        fit = growth.fit_one(t, y, unc, "logistic")
        k, r, m = fit["params"].values()
        w = np.ones(60) if unc is None else unc
        x = np.exp(-r * (t - m))
        slope = np.stack([1 / (1 + x), k * (t - m) * x / (1 + x) ** 2, -k * r * x / (1 + x) ** 2], axis=1) / w[:, None]
        z = (y - k / (1 + x)) / w
        cov = np.linalg.inv(slope.T @ slope) * (1 if unc is not None else (z @ z) / 57)
        assert list(fit["stderr"].values()) == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-5)


@pytest.mark.parametrize(("name", "phi"), [("linear", 0.8), ("sqrt", 0.5), ("logistic", 0.7), ("power", 0.6), ("gompertz", 0.4)])
def test_correlated_errors_reach_the_likelihoods_maximum(name, phi):
    """Against a dense grid of correlations, with the parameters solved for each."""
    model = growth.MODELS[name]
    for seed in range(3):
        t, y = noisy(name, seed, 61, phi, 1.0)
        s = fitting.Series.of([t], [y], [None])
        start = np.array([model.start(t, y)])
        q, _ = fitting.solve(s, model.law(), start)
        q, got, good = fitting.solve_correlated(s, model.law(), q)
        fit = fitting.assess(s, model.law(), q, got, good)
        grid = [fitting.assess(s, model.law(), fitting.solve(s, model.law(), q, np.array([f]))[0], np.array([f]), good).deviance[0] for f in np.linspace(0.005, 0.98, 196)]
        assert good[0] and fit.deviance[0] <= min(grid) + 1e-3


def test_gaps_in_units_of_the_typical_one():
    """The typical gap is the median of all, repeated times included; no gap is under a millionth of it."""
    s = fitting.Series.of([np.array([0.0, 1, 1, 3, 7]), np.array([0.0, 0, 0, 5.0])], [np.zeros(5), np.zeros(4)], [None, None])
    assert s.lag[0].tolist() == pytest.approx([2 / 3, 1e-6, 4 / 3, 8 / 3]) or s.lag[0].tolist() == pytest.approx([1 / 1.5, 1e-6, 2 / 1.5, 4 / 1.5])
    assert s.lag[1, :3].tolist() == [1e-6, 1e-6, 5.0]
    assert (s.correlation(np.array([0.5, 0.5]))[:, 1:] <= 1 - 1e-9).all() and s.correlation(np.array([0.5, 0.5]))[1, 4] == 0


def test_draws_of_one_series_side_by_side():
    for name in ("linear", "logistic", "sqrt_lag", "richards"):
        model, rng = growth.MODELS[name], np.random.default_rng(5)
        law, q = model.law(), np.array(TRUE[name])
        s = fitting.Series.of([T], [model.value(T, *q) + rng.normal(0, 0.5, 60)], [None])
        y = growth.simulate(s, law, q, 0.0, 30, rng)
        found, good = fitting.solve(s.drawn(y), law, np.tile(q, (30, 1)), rounds=100, fine=1e-9)
        assert good.mean() > 0.9
        for k in np.flatnonzero(good)[:8]:
            one = growth.fit_one(T, y[k], None, name, start=q)
            a, b = model.value(T, *found[k]), model.value(T, *one["params"].values())
            assert ((y[k] - a) ** 2).sum() <= ((y[k] - b) ** 2).sum() * (1 + 1e-4)


def test_odd_series():
    assert growth.fit_one(np.zeros(2), np.zeros(2), None, "logistic")["message"] == "too few points: 2"
    for name in TRUE:
        for y in (np.zeros(30), np.full(30, 7.0), -np.arange(30.0), np.where(np.arange(30) % 2, 1e9, -1e9)):
            fit = growth.fit_one(np.arange(30.0), y, None, name, "auto")
            assert fit["ok"] or fit["message"] == "no convergence"
    same = growth.fit_one(np.zeros(9), np.arange(9.0), None, "linear", "auto")
    assert not same["ok"] or "no covariance" in same["warnings"]


def test_series_of_many_lengths_in_spark(spark):
    rows = [(k, name, float(a), float(b), None) for name in ("linear", "logistic") for k in range(12) for a, b in zip(*noisy(name, k, 10 + 5 * k))]
    p = spark.createDataFrame([*rows, (99, "linear", None, 1.0, None), (98, "linear", 1.0, None, None), (97, "linear", 1.0, 2.0, 3.0)], "k int, kind string, t double, y double, unc double")
    got = {(r.k, r.kind, r.model): r for r in growth.fit_growth(p, ["k", "kind"], ("linear", "logistic", "power"), "auto").collect()}
    assert len(got) == 25 * 3 and got[97, "linear", "power"].message == "too few points: 1"
    for k in (0, 5, 11):
        t, y = noisy("logistic", k, 10 + 5 * k)
        one = growth.fit_one(t, y, None, "logistic", "auto")
        r = got[k, "logistic", "logistic"]
        assert r.aic == pytest.approx(one["aic"], abs=1e-4) and r.t_first == t[0] and r.t_last == t[-1] and r.error_model == one["error_model"]
    assert growth.fit_growth(p.where("k < 0"), ["k", "kind"]).count() == 0
    whole = growth.fit_growth(p.where("k = 3 and kind = 'linear'"), [], ("linear",)).collect()
    assert len(whole) == 1 and whole[0].n == 25
