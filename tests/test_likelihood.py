"""Exact likelihood against the density of the whole series, and fits against a search."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.functions import likelihood as core


def density(w, phi, theta, const):
    """Log-likelihood at the best mean and variance, from the covariance of all values."""
    n, m = len(w), 2000
    psi = np.zeros(m)
    psi[0] = 1
    for j in range(1, m):
        psi[j] = theta[j - 1] if j <= len(theta) else 0
        psi[j] += sum(phi[i] * psi[j - 1 - i] for i in range(min(len(phi), j)))
    gamma = np.array([psi[:m - k] @ psi[k:] for k in range(n)])
    v = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    back, one = np.linalg.inv(v), np.ones(n)
    mean = (one @ back @ w) / (one @ back @ one) if const else 0.0
    e = w - mean
    variance = e @ back @ e / n
    value = -0.5 * (n * (np.log(2 * np.pi) + 1 + np.log(variance)) + np.linalg.slogdet(v)[1])
    following = mean + (np.append(gamma, psi[:m - n] @ psi[n:])[1:][::-1] @ back @ e)
    return value, mean, variance, following


@pytest.mark.parametrize("p,q", [(0, 0), (0, 1), (1, 0), (2, 1), (1, 2), (0, 3), (3, 0)])
@pytest.mark.parametrize("const", [True, False])
def test_likelihood_is_the_density(p, q, const):
    rng = np.random.default_rng(10 * p + q)
    n = np.array([60, 45, 80, 30])
    w = rng.normal(size=(4, 80)).cumsum(axis=1) * 0.1 + rng.normal(size=(4, 80)) + 2
    phi, theta = core.coefficients(rng.normal(size=(4, p + q)), p)
    found = core.kalman(w, n, phi, theta, keep=True)
    high = core.log_likelihood(found, n, const)
    for i in range(4):
        value, mean, variance, following = density(w[i, :n[i]], phi[i], theta[i], const)
        assert high[i] == pytest.approx(value, rel=1e-9)
        assert found.variance(n, const)[i] == pytest.approx(variance, rel=1e-9)
        mu = found.mean(const)[i]
        assert mu == pytest.approx(mean, rel=1e-8, abs=1e-9)
        assert mu + found.ahead[i, 0] - mu * found.ahead[i, 1] == pytest.approx(following, rel=1e-7)


@pytest.mark.parametrize("p,q", [(0, 1), (1, 0), (1, 1)])
def test_maximum_beats_a_search(p, q):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(6, 120))
    w = e.copy()
    for t in range(1, 120):
        w[:, t] += 0.5 * w[:, t - 1] * (p > 0) + 0.6 * e[:, t - 1] * (q > 0)
    n = np.full(6, 120)
    phi, theta, done = core.maximised(w, n, p, q, True)
    best = core.log_likelihood(core.kalman(w, n, phi, theta), n, True)
    grid = np.linspace(-0.98, 0.98, 25)
    for a in grid if p else [0.0]:
        for b in grid if q else [0.0]:
            tried = core.kalman(w, n, np.full((6, p), a), np.full((6, q), b))
            assert (core.log_likelihood(tried, n, True) <= best + 1e-9).all()
    assert done.all()
    one = core.maximised(w[:1], n[:1], p, q, True)
    np.testing.assert_allclose(np.concatenate([*one[:2]], axis=1)[0],
                               np.concatenate([phi, theta], axis=1)[0], atol=1e-9)


def test_edge_of_invertibility():
    """Differences of noise: the best coefficient is at the edge, where it stays finite."""
    rng = np.random.default_rng(5)
    w = np.diff(rng.normal(size=(3, 90)), axis=1)
    _, theta, _ = core.maximised(w, np.full(3, 89), 0, 1, False)
    assert (theta < -0.85).all() and (theta >= -1).all()


@pytest.mark.parametrize("order,const", [((0, 1, 1), True), ((1, 0, 1), True), ((2, 1, 0), False),
                                         ((0, 2, 1), True), ((0, 1, 0), True)])
def test_walk_forward_refits(walks, panel, order, const):
    p, d, q = order
    got = tm.walk_forward_likelihood(panel, "series_id", order=order, const=const, split=0.9).toPandas()
    for name, rows in walks.groupby("series_id"):
        y, size = rows.y.to_numpy(), int(len(rows) * 0.9)
        mine = got[got.series_id == name].sort_values("ds")
        assert list(mine.ds) == list(rows.ds[size:])
        for t, yhat in list(zip(range(size, len(y)), mine.yhat.astype(float)))[::4]:
            w = np.diff(y[:t], d)
            phi, theta, _ = core.maximised(w[None], np.array([len(w)]), p, q, const)
            change = density(w, phi[0], theta[0], const)[3]
            base = 0 if d == 0 else y[t - 1] if d == 1 else 2 * y[t - 1] - y[t - 2]
            assert yhat == pytest.approx(base + change, abs=1e-6)


def test_refit_every_so_many_rows(walks, panel):
    got = tm.walk_forward_likelihood(panel, "series_id", order=(0, 1, 1), refit=10).toPandas()
    rows = walks[walks.series_id == "a"]
    y, mine = rows.y.to_numpy(), got[got.series_id == "a"].sort_values("ds")
    size = int(len(y) * 0.7)
    assert len(mine) == len(y) - size
    for t, yhat in zip(range(size, len(y)), mine.yhat.astype(float)):
        fitted = np.diff(y[:size + (t - size) // 10 * 10])
        _, theta, _ = core.maximised(fitted[None], np.array([len(fitted)]), 0, 1, True)
        mean = density(fitted, [], theta[0], True)[1]
        seen = np.diff(y[:t]) - mean
        found = core.kalman(seen[None], np.array([len(seen)]), theta[:, :0], theta)
        assert yhat == pytest.approx(y[t - 1] + mean + found.ahead[0, 0], abs=1e-9)


def test_pieces_of_a_series_are_dealt_out(spark, panel, monkeypatch):
    from tidemark.operators import likelihood
    whole = tm.walk_forward_likelihood(panel, "series_id").select("series_id", "ds", "yhat")
    monkeypatch.setattr(likelihood, "PIECE", 4)
    cut = tm.walk_forward_likelihood(panel, "series_id").select("series_id", "ds", "yhat")
    both = whole.join(cut.withColumnRenamed("yhat", "other"), ["series_id", "ds"])
    assert both.count() == whole.count() == cut.count()
    assert both.where(F.abs(F.col("yhat") - F.col("other")) > 1e-9).count() == 0


def test_short_and_flat_series_say_so(spark):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(40)]
    rows = [("short", d, float(i % 3)) for i, d in enumerate(days[:9])]
    rows += [("line", d, float(i)) for i, d in enumerate(days)] + [("one", days[0], 1.0), ("none", days[0], None)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double")
    got = tm.walk_forward_likelihood(df, "series_id").groupBy("series_id").agg(
        F.collect_set("status").alias("s"), F.count("yhat").alias("n")).collect()
    assert {r.series_id: (r.s, r.n) for r in got} == {
        "short": (["short"], 0), "line": (["singular"], 0), "one": (["short"], 0)}
    fits = {r.series_id: r for r in tm.fit_likelihood(df, "series_id").collect()}
    assert fits["line"].status == "singular" and fits["one"].yhat is None and "none" not in fits


def test_fit_and_profile_agree(panel):
    fit = tm.fit_likelihood(panel, "series_id", order=(0, 1, 1), freq="W").collect()
    for r in fit:
        at = [((), (t,)) for t in (r.theta[0], r.theta[0] + 0.01, r.theta[0] - 0.01)]
        rows = tm.likelihood_profile(panel.where(F.col("series_id") == r.series_id), "series_id", models=at)
        high = {x.model: x.loglik for x in rows.collect()}
        assert high[0] == pytest.approx(r.loglik, rel=1e-10) and high[0] > max(high[1], high[2])
        assert r.aic == pytest.approx(2 * 3 - 2 * r.loglik) and r.status == "ok"


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "series_id string, ds date, y double")
    assert tm.walk_forward_likelihood(empty, "series_id").count() == 0
    assert tm.fit_likelihood(empty, "series_id").count() == 0
