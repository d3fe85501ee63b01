from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidemark as tm


@pytest.fixture(scope="module")
def daily():
    rng = np.random.default_rng(5)
    days = pd.date_range("2019-01-01", periods=400, freq="D")
    keep = rng.random(400) > 0.2
    keep[60:75] = False
    return pd.DataFrame({"series_id": "s", "ds": days[keep].date,
                         "y": 50 + rng.standard_normal(keep.sum())})


@pytest.fixture(scope="module")
def daily_panel(spark, daily):
    twice = pd.concat([daily, daily.assign(y=daily.y + 1)])
    return spark.createDataFrame(twice, "series_id string, ds date, y double")


def series(daily):
    return pd.Series(daily.y.to_numpy() + 0.5, index=pd.to_datetime(daily.ds))


@pytest.mark.parametrize("freq", ["D", "W"])
@pytest.mark.parametrize("gaps", ["keep", "drop"])
def test_resample_as_pandas(daily, daily_panel, freq, gaps):
    want = series(daily).resample(freq).mean()
    if gaps == "drop":
        want = want.dropna()
    got = tm.resample(daily_panel, "series_id", freq=freq, gaps=gaps).orderBy("ds").toPandas()
    assert list(got.ds) == list(want.index.date)
    np.testing.assert_allclose(got.y.astype(float), want.to_numpy(), rtol=1e-12)


def test_weeks_are_labelled_by_their_sunday(spark):
    days = [date(2019, 4, 15) + timedelta(days=i) for i in range(7)]
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    assert {r[0] for r in rows.select(tm.week_end(F.col("d"))).collect()} == {date(2019, 4, 21)}


def test_rolling_as_pandas(walks, panel):
    got = tm.rolling(panel, "series_id", window=52).orderBy("series_id", "ds").toPandas()
    want = walks.sort_values(["series_id", "ds"]).groupby("series_id").y
    np.testing.assert_allclose(got.rolling_mean, want.rolling(52).mean(), rtol=1e-10)
    np.testing.assert_allclose(got.rolling_std, want.rolling(52).std(), rtol=1e-8)


def test_difference_as_pandas(walks, panel):
    got = tm.difference(panel, "series_id").orderBy("series_id", "ds").toPandas()
    want = walks.sort_values(["series_id", "ds"]).groupby("series_id").y.diff()
    np.testing.assert_allclose(got.w, want, rtol=1e-12)


@pytest.mark.parametrize("d", [0, 1, 2])
def test_integrating_undoes_differencing(panel, d):
    back = tm.integrate(tm.difference(panel, "series_id", d=d), "series_id", "w", d)
    rows = back.select("y", "level").toPandas().dropna()
    assert len(rows) == panel.count() - 3 * d
    np.testing.assert_allclose(rows.level, rows.y, rtol=1e-12)


def test_log_of_nothing_is_null(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (-2.0,)], "y double")
    assert [r[0] for r in tm.log(rows).collect()] == [0.0, None, None]


@pytest.mark.parametrize("period", [12, 7])
def test_decomposition(walks, panel, period):
    got = tm.decompose(panel, "series_id", period=period).orderBy("series_id", "ds").toPandas()
    half = period // 2
    weights = np.ones(period + 1 - period % 2)
    if period % 2 == 0:
        weights[[0, -1]] = 0.5
    for name, rows in got.groupby("series_id"):
        y = rows.y.to_numpy()
        trend = np.full(len(y), np.nan)
        trend[half : len(y) - half] = np.convolve(y, weights / period, mode="valid")
        np.testing.assert_allclose(rows.trend, trend, rtol=1e-10)
        cycle = np.array([np.nanmean((y - trend)[i::period]) for i in range(period)])
        cycle -= cycle.mean()
        np.testing.assert_allclose(rows.seasonal, np.resize(cycle, len(y)), atol=1e-10)
        assert abs(rows.seasonal.to_numpy()[:period].sum()) < 1e-9
        whole = rows.dropna()
        np.testing.assert_allclose(whole.trend + whole.seasonal + whole.resid, whole.y, rtol=1e-12)


def test_decomposition_says_why_not(spark, panel):
    short = tm.decompose(panel, "series_id", period=80).where("trend is not null or status = 'ok'")
    assert short.count() == 0
    holed = panel.withColumn("y", F.when(F.dayofmonth("ds") > 3, F.col("y")))
    assert {r[0] for r in tm.decompose(holed, "series_id", period=12).select("status").collect()} == {
        "missing"
    }


def test_describe_as_pandas(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({
        "k": rng.choice(["a", "b", "c"], 3000, p=[0.6, 0.3, 0.1]),
        "v": np.round(rng.standard_normal(3000) * 10.0 ** rng.integers(-3, 4, 3000), 4),
        "w": rng.integers(0, 3, 3000).astype(float),
    })
    data.loc[data.w == 1, "v"] = 7.0  # one value fills a third of the rows
    df = spark.createDataFrame(data)
    for by in ([], ["k"]):
        got = tm.describe(df, ["v", "w"], by=by, quartiles=True).toPandas()
        for _, row in got.iterrows():
            part = data[row["column"]] if not by else data[data.k == row.k][row["column"]]
            want = part.describe()
            np.testing.assert_allclose(
                row[["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float),
                want[["count", "mean", "std", "min", "25%", "50%", "75%", "max"]], rtol=1e-9,
            )


def test_describe_skips_nan_and_reads_text(spark):
    df = spark.createDataFrame([(float("nan"), "3"), (2.0, "x"), (4.0, "5")], "v double, t string")
    rows = {r["column"]: r for r in tm.describe(df).collect()}
    assert (rows["v"]["count"], rows["v"]["mean"], rows["v"]["min_text"]) == (2, 3.0, None)
    assert (rows["t"]["count"], rows["t"]["mean"]) == (3, 4.0)
    assert (rows["t"]["min_text"], rows["t"]["max_text"]) == ("3", "x")


def test_describe_takes_numeric_and_text_columns(spark, panel):
    assert {r["column"] for r in tm.describe(panel).collect()} == {"series_id", "y"}


def test_approximate_quartiles_are_close(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    row = tm.describe(df, ["v"], quartiles=True, approx=True).first()
    assert abs(row.q50 - 5000) <= 2


def test_fraction_is_taken_in_binary(spark):
    rows = spark.range(90).select(F.lit("s").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"),
                                  F.col("id").cast("int")).alias("ds"))
    assert tm.split(rows, "k", frac=0.7).where("is_test").count() == 90 - int(90 * 0.7)
    assert int(90 * 0.7) == 62
    assert tm.split(rows, "k", last=7).where("is_test").count() == 7
    with pytest.raises(ValueError):
        tm.split(rows, "k")


def test_slices(walks, panel):
    for name, rows in walks.groupby("series_id"):
        mine = panel.where(F.col("series_id") == name)
        days = list(rows.ds)
        got = lambda df: sorted(r.ds for r in df.collect())
        assert got(tm.head(mine, "series_id", 5)) == days[:5]
        assert got(tm.tail(mine, "series_id", 6)) == days[-6:]
        assert got(tm.slice_end(mine, "series_id", 70, 5)) == days[-70:-5]
        assert got(tm.slice_end(mine, "series_id", 80)) == days[-80:]


def test_date_range(spark):
    rows = spark.sql("SELECT explode(sequence(date'2018-01-01', date'2022-01-01')) AS ds")
    got = tm.date_range(rows, "ds", end=date(2021, 5, 31), months=36)
    assert (got.agg(F.min("ds"), F.max("ds")).first()) == (date(2018, 5, 31), date(2021, 5, 31))
    stamps = rows.select(F.col("ds").cast("timestamp") + F.expr("interval 5 hours"))
    stamps = stamps.toDF("ds")
    assert tm.date_range(stamps, "ds", date(2020, 1, 1), date(2020, 1, 31)).count() == 31


def test_to_series_turns_nan_into_null(spark):
    df = spark.createDataFrame([("a", "2020-01-01", float("nan")), ("a", "bad", 2.0)],
                               "k string, d string, v double")
    rows = tm.to_series(df, "k", "d", "v").collect()
    assert rows[0].y is None and rows[0].ds == date(2020, 1, 1) and rows[1].ds is None
    assert tm.drop_missing(tm.to_series(df, "k", "d", "v"), "y").count() == 1


def test_quartiles_of_infinite_values_and_many_keys(spark):
    rng = np.random.default_rng(3)
    values = [1.0, 2.0, float("inf"), 3.0], [float("-inf")] * 3, [5.0] * 2000, rng.normal(size=4001)
    rows = [(k, float(v)) for k, part in enumerate(values) for v in part]
    rows += [(k, float(v)) for k in range(10, 60) for v in rng.integers(0, 9, k)]
    df = spark.createDataFrame([*rows, (None, 7.0), (99, None)], "k int, v double")
    got = {r.k: (r.q25, r.q50, r.q75) for r in tm.describe(df, ["v"], by="k", quartiles=True).collect()}
    assert got[0] == (1.75, 2.5, float("inf")) and got[1] == (float("-inf"),) * 3
    assert got[None] == (7.0,) * 3 and got[99] == (None,) * 3
    for k in (2, 3, *range(10, 60)):
        want = np.quantile([v for i, v in rows if i == k], [0.25, 0.5, 0.75])
        assert np.allclose(got[k], want, atol=1e-12)


def test_quartiles_read_the_table_twice(spark, tmp_path, monkeypatch):
    """For the statistics and bounds, and for the counts; each plan has one scan of the table."""
    from tidemark.operators import describe
    spark.range(5000).selectExpr("id % 7 k", "id a", "id * 2 b", "id % 3 c", "-id d", "id + 1 e").write.parquet(
        str(tmp_path / "t"))
    rows, plans = spark.read.parquet(str(tmp_path / "t")), []

    def seen(function):
        def run(*args):
            out = function(*args)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out
        return run

    monkeypatch.setattr(describe, "counted", seen(describe.counted))
    for by in ([], ["k"]):
        found = describe.describe(rows, ["a", "b", "c", "d", "e"], by, quartiles=True)
        text = plans.pop()
        assert text.count(str(tmp_path / "t")) == 1 and "NestedLoop" not in text and "Window" not in text
        final = found._jdf.queryExecution().executedPlan().toString()
        assert str(tmp_path / "t") not in final and "NestedLoop" not in final
        # Running counts are taken inside a range of values.
        windows = [w for w in final.split("Window [")[1:]]
        assert all("_range" in w.split("\n")[0] for w in windows)
        got = {(r["column"], r.k if by else None): (r.q25, r.q50, r.q75) for r in found.collect()}
        table = np.arange(5000)
        for k in range(7) if by else [None]:
            part = table[table % 7 == k] if by else table
            for name, v in (("a", part), ("b", part * 2), ("c", part % 3), ("d", -part), ("e", part + 1)):
                assert got[name, k] == tuple(np.quantile(v, [0.25, 0.5, 0.75]))


def test_quartiles_of_a_million_values(spark):
    df = spark.range(1_000_000).selectExpr(
        "pmod(id * 2654435761, 1000003) / 7D v", "CASE WHEN id % 10 < 4 THEN 1.5D ELSE double(id) END w",
        "log(id + 1) x")
    rows = df.toPandas()
    got = {r["column"]: r for r in tm.describe(df, quartiles=True).collect()}
    for c in "vwx":
        assert np.allclose([got[c].q25, got[c].q50, got[c].q75], rows[c].quantile([0.25, 0.5, 0.75]), rtol=1e-12)


def test_align_meets_null_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    rows = {r.k: (r.a, r.b) for r in tm.align(a, b, ["k"]).collect()}
    assert rows == {"x": (1, None), None: (2, 3), "y": (None, 4)}


def test_align_and_stack(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, b string")
    rows = {r.k: (r.a, r.b) for r in tm.align(a, b, ["k"]).collect()}
    assert rows == {1: ("x", None), 2: ("y", "z"), 3: (None, "w")}
    assert tm.stack(a, a.select("a", "k")).count() == 4


def test_plot_frame(panel):
    got = tm.plot_frame(tm.rolling(panel, "series_id"), "series_id",
                        {"level": "y", "mean": "rolling_mean"})
    assert got.columns == ["series_id", "ds", "panel", "value"]
    assert got.count() == 2 * panel.count()


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_windows_in_blocks(spark, panel, rows):
    """With repeated dates in other series, gaps, nulls and a row without a date."""
    odd = panel.withColumn("y", F.when(F.dayofyear("ds") % 11 != 0, F.col("y"))).unionByName(
        spark.createDataFrame([("a", None, 5.0)], panel.schema))
    for whole, cut in (
        (tm.rolling(odd, "series_id", window=9), tm.rolling(odd, "series_id", window=9, block_rows=rows)),
        (tm.difference(odd, "series_id", d=2), tm.difference(odd, "series_id", d=2, block_rows=rows)),
        (tm.integrate(odd, "series_id", "y", 1), tm.integrate(odd, "series_id", "y", 1, block_rows=rows)),
    ):
        assert whole.columns == cut.columns
        assert whole.exceptAll(cut).count() == 0 and whole.count() == cut.count()


def test_sums_of_buckets_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), date(2021, 1, 1) + timedelta(days=int(d)), round(float(v), 2))
            for k, d, v in zip(rng.integers(0, 20, 500), rng.integers(0, 90, 500), rng.normal(size=500))]
    df = spark.createDataFrame([*rows, (3, date(2021, 1, 9), None)], "k int, ds date, y double")
    for freq in "DW":
        sums = tm.bucket_sums(df, "k", 2, freq=freq).withColumn("g", F.col("k") % 3)
        want = tm.resample(df.withColumn("g", F.col("k") % 3), "g", freq=freq, gaps="keep", places=2)
        got = tm.means_of_sums(sums, "g", 2, freq=freq, gaps="keep")
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
