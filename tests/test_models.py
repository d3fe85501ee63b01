from datetime import date, timedelta

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidemark as tm

ORDERS = [((0, 1, 0), True), ((0, 1, 0), False), ((0, 2, 0), True), ((0, 0, 0), True),
          ((1, 0, 0), True), ((1, 1, 0), True), ((1, 1, 0), False), ((2, 1, 0), False),
          ((2, 1, 0), True), ((3, 1, 0), True), ((4, 2, 0), True), ((0, 1, 1), True),
          ((0, 2, 1), True), ((0, 1, 2), True), ((0, 1, 3), True), ((1, 1, 1), False),
          ((2, 1, 1), True), ((2, 2, 1), True), ((1, 0, 1), True), ((4, 0, 4), True)]


@pytest.mark.parametrize("order,const", ORDERS)
def test_walk_forward_equals_refits(walks, panel, order, const):
    got = tm.walk_forward(panel, "series_id", order=order, const=const).toPandas()
    got = got.sort_values(["series_id", "ds"])
    for name, rows in walks.groupby("series_id"):
        size = int(len(rows) * 0.7)
        want = brute.forecasts(rows.y.to_numpy(), order, const)[size:]
        mine = got[got.series_id == name]
        assert list(mine.ds) == list(rows.ds[size:])
        np.testing.assert_allclose(mine.yhat.astype(float), want, rtol=1e-7)
        assert set(mine.status) == {"ok"}
        assert set(zip(mine.p, mine.d, mine.q, mine.const)) == {(*order, const)}


def test_several_orders_in_one_pass(panel):
    orders = [(0, 1, 1), (3, 1, 0), (2, 1, 1)]
    both = tm.walk_forward(panel, "series_id", order=orders)
    alone = tm.stack(*[tm.walk_forward(panel, "series_id", order=o) for o in orders])
    assert both.columns == alone.columns
    assert both.exceptAll(alone).count() == 0 and both.count() == alone.count()


def test_forecasts_do_not_look_ahead(walks, panel):
    cut = sorted(walks[walks.series_id == "a"].ds)[100]
    moved = panel.withColumn(
        "y", F.when((F.col("series_id") == "a") & (F.col("ds") >= cut), F.col("y") + 3)
        .otherwise(F.col("y"))
    )
    for order in ((2, 1, 1), (1, 0, 0), (0, 1, 2)):
        upto = (F.col("series_id") != "a") | (F.col("ds") <= cut)
        pick = ["series_id", "ds", "yhat"]
        one = tm.walk_forward(panel, "series_id", order=order).where(upto).select(*pick)
        two = tm.walk_forward(moved, "series_id", order=order).where(upto).select(*pick)
        assert one.exceptAll(two).count() == 0 and one.count() == two.count()


def test_a_panel_is_the_union_of_its_series(panel):
    whole = tm.walk_forward(panel, "series_id", order=(2, 1, 1))
    alone = tm.walk_forward(panel.where("series_id = 'b'"), "series_id", order=(2, 1, 1))
    assert whole.where("series_id = 'b'").exceptAll(alone).count() == 0


@pytest.mark.parametrize("order", [(1, 1, 0), (0, 1, 1), (3, 1, 0), (2, 1, 1)])
def test_next_step(walks, panel, order):
    got = {r.series_id: r for r in tm.forecast_next(panel, "series_id", order=order, freq="W").collect()}
    for name, rows in walks.groupby("series_id"):
        # A further value of any size; its own forecast does not depend on it.
        want = brute.forecasts(np.append(rows.y.to_numpy(), 0.0), order)[-1]
        assert got[name].ds == max(rows.ds) + timedelta(days=7)
        assert got[name].yhat == pytest.approx(want, rel=1e-8)


def test_short_and_singular_series_say_so(spark):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(60)]
    rows = [("short", d, float(i)) for i, d in enumerate(days[:9])]
    rows += [("line", d, float(i)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double")
    got = tm.walk_forward(df, "series_id", order=(3, 1, 0)).groupBy("series_id").agg(
        F.collect_set("status").alias("s"), F.count("yhat").alias("n")).collect()
    assert {r.series_id: (r.s, r.n) for r in got} == {"short": (["short"], 0), "line": (["singular"], 0)}


def simulate(n, phi, theta, seed):
    rng = np.random.default_rng(seed)
    e = rng.standard_normal(n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return w, e


@pytest.mark.parametrize("phi,theta,order", [(0.7, 0, (1, 0, 0)), (0, 0.5, (0, 0, 1)),
                                             (0.6, 0.4, (1, 0, 1))])
def test_forecasts_approach_the_true_model(spark, phi, theta, order):
    w, e = simulate(3000, phi, theta, 8)
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(len(w))]
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "ds": days, "y": w}),
                               "series_id string, ds date, y double")
    fit = tm.walk_forward(df, "series_id", order=order, long_lags=5)
    got = tm.score(fit, "series_id").first()
    best = np.mean(e[2100:] ** 2)
    assert got.mse < 1.03 * best


@pytest.fixture(scope="module")
def grid(panel):
    return tm.grid_search(panel, "series_id").cache()


def test_grid_has_every_order(grid):
    assert grid.count() == 3 * 75
    assert grid.where("status = 'ok'").count() == 3 * 75


@pytest.mark.parametrize("order", [(0, 0, 0), (0, 1, 0), (1, 1, 0), (4, 0, 0), (0, 1, 2), (2, 1, 1),
                                   (2, 2, 1), (4, 2, 4)])
def test_grid_equals_refits(walks, grid, order):
    got = {r.series_id: r.rmse for r in grid.where(
        (F.col("p") == order[0]) & (F.col("d") == order[1]) & (F.col("q") == order[2])).collect()}
    for name, rows in walks.groupby("series_id"):
        assert got[name] == pytest.approx(brute.grid_rmse(rows.y.to_numpy(), order), rel=1e-6)


def test_best_order_is_the_first_of_the_lowest(spark, grid):
    rows = grid.toPandas()
    for r in tm.best_order(grid, "series_id").collect():
        mine = rows[rows.series_id == r.series_id].sort_values(["rmse", "p", "d", "q"]).iloc[0]
        assert (r.p, r.d, r.q) == (mine.p, mine.d, mine.q)
    tied = spark.createDataFrame([("s", 1, 0, 0, 2.0), ("s", 0, 1, 1, 2.0), ("s", 0, 0, 1, None)],
                                 "series_id string, p int, d int, q int, rmse double")
    best = tm.best_order(tied, "series_id").first()
    assert (best.p, best.d, best.q) == (0, 1, 1)


def test_grid_reports_orders_that_fail(spark):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([("s", d, float(i % 4)) for i, d in enumerate(days)],
                               "series_id string, ds date, y double")
    got = tm.grid_search(df, "series_id")
    assert got.count() == 75
    assert got.where("status = 'failed' and rmse is null and p + q > 0").count() == 72


def test_adf_equals_brute_force(walks, panel):
    got = {r.series_id: r for r in tm.adf(panel, "series_id").collect()}
    for name, rows in walks.groupby("series_id"):
        stat, lag, n = brute.adf(rows.y.to_numpy())
        assert (got[name].used_lag, got[name].n_obs) == (lag, n)
        assert got[name].stat == pytest.approx(stat, rel=1e-7)


def test_adf_tells_noise_from_a_walk(spark):
    rng = np.random.default_rng(0)
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(500)]
    noise = rng.standard_normal(500)
    df = spark.createDataFrame(
        [("noise", d, float(v)) for d, v in zip(days, noise)]
        + [("walk", d, float(v)) for d, v in zip(days, np.cumsum(noise))],
        "series_id string, ds date, y double")
    got = {r.series_id: r for r in tm.adf(df, "series_id").collect()}
    assert got["noise"].stationary and got["noise"].p_value < 0.001
    assert not got["walk"].stationary and got["walk"].p_value > 0.05
    assert tm.adf(df.where("series_id = 'walk'"), []).first().stat == pytest.approx(got["walk"].stat)


def test_adf_of_a_long_series_by_blocks(spark):
    """120,000 rows: a lag above 64, and more than one block of rows."""
    rng = np.random.default_rng(8)
    y = np.cumsum(rng.standard_normal(120_000)) + rng.standard_normal(120_000)
    df = spark.range(len(y)).select(
        F.lit("x").alias("series_id"), F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int"))
        .alias("ds"), "id")
    values = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(y)), "y": y}))
    got = tm.adf(df.join(values, "id").drop("id"), "series_id", autolag=None).first()
    dy, top = np.diff(y), int(np.ceil(12 * (len(y) / 100) ** 0.25))
    past = np.lib.stride_tricks.sliding_window_view(dy, top + 1)[:, ::-1]
    x = np.column_stack([np.ones(len(past)), y[top:-1], past[:, 1:]])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ (x.T @ past[:, 0])
    ssr = ((past[:, 0] - x @ beta) ** 2).sum()
    want = beta[1] / np.sqrt(ssr / (len(x) - x.shape[1]) * inverse[1, 1])
    assert got.used_lag == top > 64 and got.n_obs == len(x)
    assert got.stat == pytest.approx(want, rel=1e-6)


def test_adf_of_a_short_series(spark):
    df = spark.createDataFrame([("s", date(2020, 1, i), float(i)) for i in range(1, 4)],
                               "series_id string, ds date, y double")
    assert tm.adf(df, "series_id").first().status == "short"


def test_critical_values(spark):
    row = spark.range(1).select(F.lit(100).alias("n")).withColumns(tm.critical_values("n")).first()
    assert (round(row.crit_1, 3), round(row.crit_5, 3), round(row.crit_10, 3)) == (-3.498, -2.891, -2.582)


def test_scores_of_the_published_table(spark):
    # Five pairs of predicted and expected prices.
    pairs = [(1843.78, 1857.53), (1847.59, 1844.03), (1766.52, 1821.01), (1799.97, 1775.57),
             (1699.47, 1777.06)]
    df = spark.createDataFrame([("s", b, a) for a, b in pairs] + [("s", 1.0, None)],
                               "k string, y double, yhat double")
    got = tm.score(df, "k").first()
    a, b = np.array(pairs).T
    assert (got.n, got.n_missing) == (5, 1)
    assert got.mse == pytest.approx(np.mean((a - b) ** 2))
    assert got.r2 == pytest.approx(1 - np.sum((a - b) ** 2) / np.sum((b - b.mean()) ** 2))


def test_score_of_a_flat_series_has_no_r2(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("s", 1.0, 2.0)], "k string, y double, yhat double")
    assert tm.score(df, "k").first().r2 is None


def test_normal_distribution_to_fourteen_digits(spark):
    """Also far out, as column arithmetic that Spark compiles."""
    import math
    from tidemark.functions.normal import erfc, normal_cdf
    x = [0.0, 1e-12, 0.1, 0.46875, 0.47, 1.0, 2.0, 3.9, 4.0, 4.1, 6.0, 9.0, 15.0, 26.0]
    z = [0.0, -1.0, 1.0, -2.0, 2.0, -8.0, 8.0, -37.0, 5.7]
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        df = spark.createDataFrame([(v,) for v in x], "x double").repartition(2)
        for r in df.select("x", erfc(F.col("x")).alias("e")).collect():
            assert r.e == pytest.approx(math.erfc(r.x), rel=2e-14)
        df = spark.createDataFrame([(v,) for v in z], "z double").repartition(2)
        for r in df.select("z", normal_cdf("z").alias("p")).collect():
            assert r.p == pytest.approx(math.erfc(-r.z / math.sqrt(2)) / 2, rel=1e-13)
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
