"""Queries on splits, scores and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import units
from tidemark.operators.arima import forecast_next, walk_forward
from tidemark.operators.evaluate import align, compare, plot_frame, predicted_vs_expected, score, stack
from tidemark.operators.resample import resample
from tidemark.operators.series import split, to_series
from tidemark.operators.transforms import log, rolling
from tidemark.plans.inputs import (
    CENTS,
    DAY_SQL,
    KEY,
    PRIORITY_INDEX_SQL,
    SUPPLIER_INDEX_SQL,
    WEEKLY_SQL,
    mean_sql,
    panel,
    priority_index,
    r6_sql,
    supplier_index,
    table,
    week_end_sql,
)
from tidemark.plans.registry import query, rounded
from tidemark.plans.sqlfit import forecast_steps
from tidemark.sources.readers import PRICE_SCHEMA, read_csv
from tidemark.sources.writers import scratch_path, write_csv

PLACED_SQL = f"""WITH {WEEKLY_SQL}, placed AS (
  SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS pos,
    count(*) OVER (PARTITION BY series_id) AS n FROM weekly)
  SELECT series_id, ds, cast(pos AS int) AS pos, n, """


@query(PLACED_SQL + "pos > floor(n * 0.7::double) AS is_test FROM placed")
def split_train_test(spark, sf_dir):
    return split(panel(spark, sf_dir), KEY, frac=0.7).drop("y")


@query(PLACED_SQL + "pos > n - 7 AS is_test FROM placed")
def split_last_n(spark, sf_dir):
    return split(panel(spark, sf_dir), KEY, last=7).drop("y")


def _walk_sql(order, index=PRIORITY_INDEX_SQL):
    steps, last = forecast_steps("levels", order)
    return f"""WITH {index},
{steps}, tested AS (SELECT series_id, ds, y, yhat FROM {last} WHERE is_test)"""


def _walk(spark, sf_dir, order=(1, 1, 0)):
    return walk_forward(priority_index(spark, sf_dir), KEY, order=order)


MSE_SQL = f"""SELECT series_id, count(*) AS n, {r6_sql('avg(pow(y - yhat, 2))', 9)} AS mse,
  {r6_sql('sqrt(avg(pow(y - yhat, 2)))', 8)} AS rmse FROM tested GROUP BY 1"""
R2_SQL = f"""SELECT series_id,
  {r6_sql('1 - sum(pow(y - yhat, 2)) / (var_pop(y) * count(*))')} AS r2 FROM tested GROUP BY 1"""


@query(f"{_walk_sql((1, 0, 0))} {MSE_SQL}")
def score_mse_rmse(spark, sf_dir):
    rows = rounded(score(_walk(spark, sf_dir, (1, 0, 0)), KEY), "mse", places=9)
    return rounded(rows, "rmse", places=8).select(KEY, "n", "mse", "rmse")


@query(f"{_walk_sql((1, 0, 0))} {R2_SQL}")
def score_r2(spark, sf_dir):
    return rounded(score(_walk(spark, sf_dir, (1, 0, 0)), KEY), "r2").select(KEY, "r2")


@query(f"{_walk_sql((0, 1, 1), SUPPLIER_INDEX_SQL)} {R2_SQL}")
def score_suppliers(spark, sf_dir):
    found = walk_forward(supplier_index(spark, sf_dir), KEY, order=(0, 1, 1))
    return rounded(score(found, KEY), "r2").select(KEY, "r2")


@query(f"""{_walk_sql((1, 1, 0))} SELECT series_id, ds, {r6_sql('exp(yhat)', 4)} AS predicted,
  {r6_sql('exp(y)', 4)} AS expected FROM tested""", name="predicted_vs_expected")
def predicted_vs_expected_levels(spark, sf_dir):
    """The flagship: weekly values, logs, one-step forecasts, both levels side by side."""
    shown = predicted_vs_expected(_walk(spark, sf_dir), KEY)
    return rounded(shown, "predicted", "expected", places=4)


@query(f"""{_walk_sql((0, 1, 1))} SELECT series_id, ds, 'observed' AS panel,
  {r6_sql('exp(y)', 4)} AS value FROM tested UNION ALL
  SELECT series_id, ds, 'forecast', {r6_sql('exp(yhat)', 4)} FROM tested""")
def plot_forecast(spark, sf_dir):
    """Observed and forecast levels as one long frame for a chart."""
    shown = predicted_vs_expected(_walk(spark, sf_dir, (0, 1, 1)), KEY)
    frame = plot_frame(shown, KEY, {"observed": "expected", "forecast": "predicted"})
    return rounded(frame, "value", places=4)


COMPARED = [(0, 1, 1), (0, 2, 1), (1, 0, 0), (0, 1, 2), (3, 1, 0)]


def _compare_sql():
    parts, rows = [], []
    for i, order in enumerate(COMPARED):
        steps, last = forecast_steps("levels", order, tag=f"m{i}_")
        parts.append(steps)
        rows.append(f"SELECT series_id, {order[0]} AS p, {order[1]} AS d, {order[2]} AS q, y, yhat "
                    f"FROM {last} WHERE is_test")
    tables = ",\n".join(parts)
    return f"""WITH {PRIORITY_INDEX_SQL},
{tables}
SELECT series_id, p, d, q, true AS const, count(*) AS n,
  {r6_sql('sqrt(avg(pow(y - yhat, 2)))', 8)} AS rmse_log,
  {r6_sql('1 - avg(pow(y - yhat, 2)) / var_pop(y)')} AS r2_log,
  {r6_sql('1 - avg(pow(exp(y) - exp(yhat), 2)) / var_pop(exp(y))')} AS r2_level
FROM ({' UNION ALL '.join(rows)}) GROUP BY series_id, p, d, q"""


@query(_compare_sql())
def model_comparison(spark, sf_dir):
    found = walk_forward(priority_index(spark, sf_dir), KEY, order=COMPARED)
    return rounded(rounded(compare(found, KEY), "rmse_log", places=8), "r2_log", "r2_level")


def _align_sql():
    tested, last = forecast_steps("levels", (1, 1, 0))
    ahead, end = forecast_steps("grown", (1, 1, 0), tag="b")
    return f"""WITH {PRIORITY_INDEX_SQL}, grown AS (
  SELECT series_id, ds, y FROM levels UNION ALL
  SELECT series_id, cast(max(ds) + interval 7 day AS date), NULL FROM levels GROUP BY series_id),
{tested}, {ahead}, forecasts AS (
  SELECT series_id, ds, yhat FROM {last} WHERE is_test UNION ALL
  SELECT series_id, ds, yhat FROM {end} WHERE pos = n)
SELECT coalesce(l.series_id, f.series_id) AS series_id, coalesce(l.ds, f.ds) AS ds,
  {r6_sql('l.y')} AS y, {r6_sql('f.yhat')} AS yhat
FROM levels l FULL JOIN forecasts f ON l.series_id = f.series_id AND l.ds = f.ds"""


@query(_align_sql())
def align_actual_forecast(spark, sf_dir):
    """All actual values next to the forecasts, which start later and end later."""
    index = priority_index(spark, sf_dir)
    found = stack(walk_forward(index, KEY).select(KEY, "ds", "yhat"),
                  forecast_next(index, KEY, freq="W").select(KEY, "ds", "yhat"))
    return rounded(align(index, found, [KEY, "ds"]), "y", "yhat")


@query(f"""WITH {PRIORITY_INDEX_SQL}, rolled AS (
    SELECT series_id, ds, y, count(y) OVER f = 52 AS whole, avg(y) OVER f AS m,
      stddev_samp(y) OVER f AS s FROM levels
    WINDOW f AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
  SELECT series_id, ds, 'level' AS panel, {r6_sql('y')} AS value FROM rolled UNION ALL
  SELECT series_id, ds, 'mean', {r6_sql('CASE WHEN whole THEN m END')} FROM rolled UNION ALL
  SELECT series_id, ds, 'std', {r6_sql('CASE WHEN whole THEN s END')} FROM rolled""", name="plot_frame")
def plot_rolling(spark, sf_dir):
    """Level, rolling mean and rolling deviation as one long frame for a chart."""
    rows = rolling(priority_index(spark, sf_dir), KEY)
    panels = {"level": "y", "mean": "rolling_mean", "std": "rolling_std"}
    return rounded(plot_frame(rows, KEY, panels), "value")


PRICES_SQL = f"""closes AS (SELECT {DAY_SQL} AS day, {mean_sql('o_totalprice')} AS close FROM orders GROUP BY 1),
levels AS (SELECT 'orders' AS series_id, {week_end_sql('day')} AS ds, ln(avg(close)) AS y
  FROM closes GROUP BY 2)"""


def _price_file(spark, sf_dir):
    """The orders of each day written as a file of prices; its path."""
    price = F.col("o_totalprice")
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(
        F.max(price).alias("High"), F.min(price).alias("Low"),
        F.min_by(price, F.col("o_orderkey")).alias("Open"),
        (F.sum(units(price, CENTS)) / 10.0 ** CENTS / F.count(price)).alias("Close"),
        F.count(price).alias("Volume"))
    path = scratch_path(spark, "prices")
    write_csv(days.withColumn("Adj Close", F.col("Close")), path)
    return path


def _file_sql():
    steps, last = forecast_steps("levels", (1, 1, 0))
    return f"""WITH {PRICES_SQL},
{steps} SELECT series_id, ds, {r6_sql('exp(yhat)', 2)} AS predicted, {r6_sql('exp(y)', 2)} AS expected
FROM {last} WHERE is_test"""


@query(_file_sql())
def file_to_forecast(spark, sf_dir):
    """From a price file to its forecast: typed read, weeks, logs, one step ahead, levels."""
    prices = read_csv(spark, _price_file(spark, sf_dir), PRICE_SCHEMA)
    series = to_series(prices.withColumn(KEY, F.lit("orders")), KEY, "Date", "Close")
    weekly = log(resample(series, KEY, freq="W"))
    shown = predicted_vs_expected(walk_forward(weekly, KEY, order=(1, 1, 0)), KEY)
    return rounded(shown, "predicted", "expected", places=2)


@query(f"""{_walk_sql((1, 1, 0))} SELECT series_id, {r6_sql('yhat')} AS yhat, {r6_sql('y')} AS y,
  ds AS date FROM tested""")
def forecast_to_file(spark, sf_dir):
    """A forecast written as text with its key, and read back."""
    path = scratch_path(spark, "forecast")
    write_csv(_walk(spark, sf_dir).select(KEY, "yhat", "y", F.col("ds").alias("date")), path)
    back = read_csv(spark, path, f"{KEY} string, yhat double, y double, date date")
    return rounded(back, "yhat", "y")
