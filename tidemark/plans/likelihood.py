"""Queries on models of largest likelihood."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.evaluate import score
from tidemark.operators.likelihood import (
    fit_likelihood,
    likelihood_profile,
    walk_forward_likelihood,
)
from tidemark.plans.inputs import (
    KEY,
    PRIORITY_INDEX_SQL,
    SUPPLIER_INDEX_SQL,
    priority_index,
    r6_sql,
    supplier_index,
)
from tidemark.plans.registry import query, rounded
from tidemark.plans.sqllikelihood import COST, best_models, differenced, filtered

# Enough rows for a fit with a mean and one coefficient.
TESTED_SQL = """instances AS (SELECT series_id, pos AS id, pos - 2 AS m FROM placed
  WHERE pos > floor(n * 0.7::double) AND pos >= 12)"""
FORECAST_SQL = f"""WITH RECURSIVE {PRIORITY_INDEX_SQL}, {differenced('levels')}, {TESTED_SQL},
{best_models('instances')}, forecasts AS (
  SELECT p.series_id, p.ds, p.y, p.before + mean + a - mean * c AS yhat FROM placed p
  JOIN best b ON b.series_id = p.series_id AND b.id = p.pos)"""


@query(f"{FORECAST_SQL} SELECT series_id, ds, {r6_sql('y')} AS y, {r6_sql('yhat')} AS yhat FROM forecasts")
def forecast_arima_ml_011(spark, sf_dir):
    """Walk-forward forecasts of order (0, 1, 1) by exact likelihood, refitted at every row."""
    found = walk_forward_likelihood(priority_index(spark, sf_dir), KEY, order=(0, 1, 1))
    return rounded(found.select(KEY, "ds", "y", "yhat"), "y", "yhat")


@query(f"""{FORECAST_SQL} SELECT series_id, count(*) AS n, 0::bigint AS n_missing,
  {r6_sql('avg(pow(y - yhat, 2))', 8)} AS mse, {r6_sql('sqrt(avg(pow(y - yhat, 2)))')} AS rmse,
  {r6_sql('1 - avg(pow(y - yhat, 2)) / var_pop(y)')} AS r2 FROM forecasts GROUP BY series_id""")
def score_arima_ml_011(spark, sf_dir):
    found = walk_forward_likelihood(priority_index(spark, sf_dir), KEY, order=(0, 1, 1))
    return rounded(rounded(score(found, KEY), "mse", places=8), "rmse", "r2")


@query(f"""WITH RECURSIVE {SUPPLIER_INDEX_SQL}, {differenced('levels')}, instances AS (
    SELECT series_id, max(pos) AS id, max(pos) - 1 AS m FROM placed GROUP BY series_id HAVING max(pos) >= 11),
  {best_models('instances')}
  SELECT b.series_id, cast(m AS bigint) AS n, {r6_sql('th', 5)} AS theta, {r6_sql('mean', 5)} AS mean,
    {r6_sql('variance', 5)} AS variance, {r6_sql('loglik', 4)} AS loglik,
    cast(p.ds + interval 7 day AS date) AS ds, {r6_sql('y + mean + a - mean * c', 5)} AS yhat
  FROM best b JOIN placed p ON p.series_id = b.series_id AND p.pos = b.id""")
def fit_arima_ml_suppliers(spark, sf_dir):
    """The model of largest likelihood of every supplier and its next week."""
    found = fit_likelihood(supplier_index(spark, sf_dir), KEY, order=(0, 1, 1), freq="W")
    found = found.where("status = 'ok'").select(
        KEY, "n", F.col("theta")[0].alias("theta"), "mean", "variance", "loglik", "ds", "yhat")
    return rounded(rounded(found, "theta", "mean", "variance", "yhat", places=5), "loglik", places=4)


THETAS = (-0.8, -0.4, 0.0, 0.4, 0.8)


@query(f"""WITH RECURSIVE {PRIORITY_INDEX_SQL}, {differenced('levels')}, models AS (
    SELECT series_id, i - 1 AS id, [{', '.join(map(str, THETAS))}][i]::double AS th, max(k) AS m
    FROM moves, generate_series(1, {len(THETAS)}) g(i) GROUP BY ALL),
  {filtered('runs', 'models')}
  SELECT series_id, cast(id AS int) AS model, {r6_sql('w1 / oo')} AS mean,
    {r6_sql('(ww - w1 * w1 / oo) / m')} AS variance,
    {r6_sql(f'-0.5::double * (m * (ln(2 * pi()) + 1) + {COST})', 4)} AS loglik
  FROM runs WHERE k = m""")
def arima_likelihood_profile(spark, sf_dir):
    """The log-likelihood of five moving-average coefficients per series."""
    found = likelihood_profile(priority_index(spark, sf_dir), KEY, d=1,
                               models=[((), (t,)) for t in THETAS])
    return rounded(rounded(found, "mean", "variance"), "loglik", places=4)
