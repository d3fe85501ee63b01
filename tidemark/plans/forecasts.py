"""Queries that forecast the log index of every series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.arima import forecast_next, walk_forward
from tidemark.plans.inputs import (
    KEY,
    PRIORITY_INDEX_SQL,
    SUPPLIER_INDEX_SQL,
    priority_index,
    r6_sql,
    supplier_index,
)
from tidemark.plans.registry import query, rounded
from tidemark.plans.sqlfit import forecast_steps


def forecast_sql(order, const=True, index=PRIORITY_INDEX_SQL):
    steps, last = forecast_steps("levels", order, const)
    return f"""WITH {index},
{steps}
SELECT series_id, ds, {r6_sql('y')} AS y, {r6_sql('yhat')} AS yhat FROM {last} WHERE is_test"""


def _forecasts(rows, order, const=True):
    found = walk_forward(rows, KEY, order=order, const=const)
    return rounded(found.select(KEY, "ds", "y", "yhat"), "y", "yhat")


def _register(name, order, const=True):
    def run(spark, sf_dir):
        return _forecasts(priority_index(spark, sf_dir), order, const)

    run.__name__ = name
    run.__doc__ = f"Walk-forward forecasts of order {order}, constant: {const}."
    query(forecast_sql(order, const))(run)


_register("forecast_drift", (0, 1, 0))
_register("forecast_naive", (0, 1, 0), const=False)
_register("forecast_mean", (0, 0, 0))
_register("forecast_drift_d2", (0, 2, 0))
_register("forecast_ar1_d0", (1, 0, 0))
_register("forecast_ar1_d1", (1, 1, 0))
_register("forecast_ar1_nc", (1, 1, 0), const=False)
_register("forecast_ar2_nc", (2, 1, 0), const=False)
_register("forecast_arima_310", (3, 1, 0))
_register("forecast_ar4", (4, 0, 0))
_register("forecast_ma1_d1", (0, 1, 1))
_register("forecast_ma1_d2", (0, 2, 1))
_register("forecast_arima_012", (0, 1, 2))
_register("forecast_arima_013", (0, 1, 3))
_register("forecast_arima_111_nc", (1, 1, 1), const=False)
_register("forecast_arima_211", (2, 1, 1))
_register("forecast_arima_221", (2, 2, 1))


@query(forecast_sql((1, 1, 0), index=SUPPLIER_INDEX_SQL))
def forecast_suppliers_ar1(spark, sf_dir):
    """One series per supplier: the number of series grows with the data."""
    return _forecasts(supplier_index(spark, sf_dir), (1, 1, 0))


@query(forecast_sql((0, 1, 1), index=SUPPLIER_INDEX_SQL))
def forecast_suppliers_ma1(spark, sf_dir):
    return _forecasts(supplier_index(spark, sf_dir), (0, 1, 1))


@query(forecast_sql((2, 1, 1), index=SUPPLIER_INDEX_SQL))
def forecast_suppliers_211(spark, sf_dir):
    return _forecasts(supplier_index(spark, sf_dir), (2, 1, 1))


def _next_sql(order):
    steps, last = forecast_steps("grown", order)
    return f"""WITH {PRIORITY_INDEX_SQL}, grown AS (
  SELECT series_id, ds, y FROM levels UNION ALL
  SELECT series_id, cast(max(ds) + interval 7 day AS date), NULL FROM levels GROUP BY series_id),
{steps}
SELECT series_id, ds, {r6_sql('yhat')} AS yhat, {r6_sql('exp(yhat)', 4)} AS level
FROM {last} WHERE pos = n"""


def _next(spark, sf_dir, order):
    rows = forecast_next(priority_index(spark, sf_dir), KEY, order=order, freq="W")
    rows = rows.select(KEY, "ds", "yhat", F.exp("yhat").alias("level"))
    return rounded(rounded(rows, "yhat"), "level", places=4)


@query(_next_sql((1, 1, 0)), name="forecast_next")
def forecast_next_week(spark, sf_dir):
    """The week after the last one, on the log and on the level."""
    return _next(spark, sf_dir, (1, 1, 0))


@query(_next_sql((2, 1, 1)), name="forecast_next_211")
def forecast_next_week_211(spark, sf_dir):
    return _next(spark, sf_dir, (2, 1, 1))
