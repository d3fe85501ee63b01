from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators.additive import SCALES, SEASONALITIES, penalised_fit, sparse_minimum

N = 800
HOLIDAY = [date(2021, 6, 12), date(2022, 6, 10)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    days = [date(2021, 1, 1) + timedelta(days=i) for i in range(N) if i % 50 != 49]
    t = np.array([(d - days[0]).days for d in days], float)
    y = 100 + 0.05 * t + np.where(t > 300, 0.1 * (t - 300), 0)
    y += 5 * np.sin(2 * np.pi * t / 365.25) + 2 * np.sin(2 * np.pi * t / 7)
    y += 8 * np.isin(days, [h + timedelta(days=o) for h in HOLIDAY for o in (-1, 0, 1)])
    y += 0.5 * rng.standard_normal(len(days))
    return pd.DataFrame({"series_id": "s", "ds": days, "y": y})


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "series_id string, ds date, y double")


@pytest.fixture(scope="module")
def holidays(spark):
    return spark.createDataFrame([("day", h, -1, 1) for h in HOLIDAY],
                                 "holiday string, ds date, lower_window int, upper_window int")


def design(data, holdout):
    """All columns of the model, written with numpy."""
    days = list(data.ds)
    n = len(days) - holdout
    first, span = days[0], (days[n - 1] - days[0]).days
    t = np.array([(d - first).days / span for d in days])
    history = int(n * 0.8)
    spots = np.linspace(0, history - 1, 24).round().astype(int)[1:]
    since = np.array([(d - date(1970, 1, 1)).days for d in days], float)
    columns = [np.ones(len(t)), t, *[np.maximum(t - t[i], 0) for i in spots]]
    for period, k in SEASONALITIES.values():
        for i in range(1, k + 1):
            columns += [np.sin(2 * np.pi * i * since / period), np.cos(2 * np.pi * i * since / period)]
    for offset in (-1, 0, 1):
        hit = {h + timedelta(days=offset) for h in HOLIDAY}
        columns.append(np.array([float(d in hit) for d in days]))
    return np.column_stack(columns), n


def test_forecast_equals_a_direct_fit(data, df, holidays):
    x, n = design(data, 7)
    y = data.y.to_numpy()
    scale = np.abs(y[:n]).max()
    a = np.column_stack([x[:n], y[:n] / scale])
    beta, noise, status = penalised_fit(a.T @ a, 56, 3, SCALES)
    want = x[n:] @ beta * scale
    got = tm.additive_forecast(df, "series_id", holidays=holidays).orderBy("ds").toPandas()
    assert list(got.ds) == list(data.ds[n:])
    np.testing.assert_allclose(got.yhat, want, rtol=1e-8)
    assert np.abs(got.yhat - got.y).max() < 3


def test_the_solution_is_the_best_point(data):
    """No small move of any coefficient lowers the penalised sum of squares."""
    x, n = design(data, 7)
    y = data.y.to_numpy()[:n] / np.abs(data.y.to_numpy()[:n]).max()
    x = x[:n]
    a = np.column_stack([x, y])
    beta, noise, status = penalised_fit(a.T @ a, 56, 3, SCALES)
    assert status == "ok"
    noise = np.sum((y - x @ beta) ** 2) / n
    k = x.shape[1]
    hinge = np.arange(2, k - 59)

    def cost(b):
        ridge = np.r_[b[:2] ** 2 / 25, b[k - 59 : k - 3] ** 2 / 0.01, b[k - 3 :] ** 2 / 100].sum()
        return (np.sum((y - x @ b) ** 2) / noise / 2 + ridge / 2
                + np.abs(b[hinge]).sum() / SCALES["changepoint"])

    at = cost(beta)
    for j in range(k):
        for step in (1e-3, -1e-3):
            moved = beta.copy()
            moved[j] += step
            assert cost(moved) > at - 1e-6


def test_without_holidays_and_without_key(df):
    keyed = tm.additive_forecast(df, "series_id").select("ds", "yhat")
    single = tm.additive_forecast(df.drop("series_id"), None).select("ds", "yhat")
    assert keyed.count() == 7
    got = keyed.join(single.withColumnRenamed("yhat", "b"), "ds").toPandas()
    np.testing.assert_allclose(got.yhat, got.b, rtol=1e-9)


def test_series_are_fitted_apart(df):
    both = df.unionByName(df.withColumns({"series_id": F.lit("t"), "y": F.col("y") * 3}))
    rows = tm.additive_forecast(both, "series_id").toPandas().pivot(
        index="ds", columns="series_id", values="yhat")
    np.testing.assert_allclose(rows["t"], 3 * rows["s"], rtol=1e-8)


def test_features(spark, holidays):
    df = spark.createDataFrame([(date(2021, 6, 11),), (date(2021, 6, 20),)], "ds date")
    got = {(r.ds, r.holiday, r.offset) for r in tm.holiday_flags(df, holidays).collect()}
    assert got == {(date(2021, 6, 11), "day", -1), (date(2021, 6, 20), None, None)}
    assert tm.holiday_days(holidays).count() == 6
    wave = tm.fourier(df, period=7.0, k=3).first().fourier
    day = (date(2021, 6, 11) - date(1970, 1, 1)).days
    assert wave[2] == pytest.approx(np.sin(4 * np.pi * day / 7))
    bend = tm.hinges(df.withColumn("t", F.lit(0.5)), "t", [0.2, 0.9]).first().hinges
    assert bend == pytest.approx([0.3, 0.0])


def test_future_frame(df):
    rows = tm.future_frame(df, "series_id", 7).where("is_future").orderBy("ds").collect()
    last = df.agg(F.max("ds")).first()[0]
    assert [r.ds for r in rows] == [last + timedelta(days=i) for i in range(1, 8)]


def test_future_rows_are_forecast(spark, df, holidays):
    dates = tm.future_frame(df, "series_id", 7)
    rows = tm.align(df, dates.drop("is_future"), ["series_id", "ds"])
    ahead = tm.additive_forecast(rows, "series_id", holidays=holidays).orderBy("ds").toPandas()
    last = df.agg(F.max("ds")).first()[0]
    assert list(ahead.ds) == [last + timedelta(days=i) for i in range(1, 8)]
    assert ahead.y.isna().all() and set(ahead.status) == {"ok"}
    # The values that a model of the same history gives when the future is known.
    known = rows.fillna(123.0, ["y"])
    same = tm.additive_forecast(known, "series_id", holidays=holidays).orderBy("ds").toPandas()
    np.testing.assert_allclose(ahead.yhat, same.yhat, rtol=1e-10)


def test_a_series_without_history_says_so(spark):
    short = spark.createDataFrame([("s", date(2020, 1, 1) + timedelta(days=i), 1.0)
                                   for i in range(8)], "series_id string, ds date, y double")
    got = tm.additive_forecast(short, "series_id").collect()
    assert len(got) == 7 and {(r.yhat, r.status) for r in got} == {(None, "short")}


def test_conditions_of_the_minimum(data):
    """Slope changes that are not zero pull with the prior's strength, zeros with no more."""
    x, n = design(data, 7)
    y = data.y.to_numpy()[:n] / np.abs(data.y.to_numpy()[:n]).max()
    a = np.column_stack([x[:n], y])
    beta, noise, status = penalised_fit(a.T @ a, 56, 3, SCALES)
    assert status == "ok"
    assert noise == pytest.approx(np.sum((y - x[:n] @ beta) ** 2) / n, rel=1e-9)
    pull = x[:n].T @ (y - x[:n] @ beta) / noise
    changes = slice(2, x.shape[1] - 59)
    price = 1 / SCALES["changepoint"]
    zero = beta[changes] == 0
    assert zero.any() and not zero.all()
    assert (np.abs(pull[changes][zero]) <= price * (1 + 1e-6)).all()
    np.testing.assert_allclose(pull[changes][~zero], price * np.sign(beta[changes][~zero]), rtol=1e-6)
    ridge = np.r_[[1 / 25] * 2, [100.0] * 56, [0.01] * 3]
    rest = np.r_[0, 1, x.shape[1] - 59 : x.shape[1]]
    np.testing.assert_allclose(pull[rest], ridge * beta[rest], rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("seed", range(8))
def test_sparse_minimum_against_all_patterns(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, 5)).cumsum(axis=0) if seed % 2 else rng.normal(size=(30, 5))
    y = x @ np.array([1.0, 0, -2, 0, 0.1]) + rng.normal(size=30)
    square, pull, price = x.T @ x, x.T @ y, 10.0 * (1 + seed)
    got, exact = sparse_minimum(square, pull, price, np.zeros(5))
    assert exact
    cost = lambda b: b @ square @ b / 2 - pull @ b + price * np.abs(b).sum()
    best = 0.0
    for pattern in np.ndindex(*(3,) * 5):
        sign = np.array(pattern) - 1
        on = np.flatnonzero(sign)
        if len(on):
            b = np.zeros(5)
            b[on] = np.linalg.solve(square[np.ix_(on, on)], pull[on] - price * sign[on])
            if (np.sign(b[on]) == sign[on]).all():
                best = min(best, cost(b))
    assert cost(got) == pytest.approx(best, abs=1e-9)


def test_bands_hold_their_share(spark):
    """Four in five values lie in the bands, of the history and of what follows it."""
    rng = np.random.default_rng(2)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(600)]
    rows = []
    for k in range(60):
        # Changes at the places the model knows, and as often in the days to come.
        slopes = np.zeros(600)
        later = 540 + np.flatnonzero(rng.random(60) < 23 / 540)
        for at in [*np.linspace(0, 431, 24).round().astype(int)[1:], *later]:
            slopes[at] = rng.laplace(0, 0.05)
        y = 50 + np.cumsum(np.cumsum(slopes)) + 0.5 * rng.standard_normal(600)
        rows += [(k, d, float(v)) for d, v in zip(days, y)]
    df = spark.createDataFrame(rows, "series_id int, ds date, y double")
    got = tm.additive_components(df, "series_id", seasonalities={}, holdout=60, interval=0.8).toPandas()
    inside = (got.y >= got.yhat_lower) & (got.y <= got.yhat_upper)
    assert 0.74 < inside[~got.is_test].mean() < 0.86
    assert 0.6 < inside[got.is_test].mean() < 0.97
    width = (got.yhat_upper - got.yhat_lower)[got.series_id == 0].to_numpy()
    tests = got.is_test[got.series_id == 0].to_numpy()
    assert np.ptp(width[~tests]) < 1e-9 and (np.diff(width[tests]) > 0).all()
    plain = tm.additive_forecast(df, "series_id", seasonalities={}, holdout=60)
    assert plain.columns == ["series_id", "ds", "y", "yhat", "status"]
