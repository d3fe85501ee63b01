"""Queries on stationarity and on the search for an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.arima import best_order, grid_search
from tidemark.operators.diagnostics import adf, critical_values, stationarity_report
from tidemark.operators.transforms import exp
from tidemark.plans.inputs import (
    KEY,
    PRIORITY_INDEX_SQL,
    SUPPLIER_INDEX_SQL,
    WEEKLY_SQL,
    panel,
    priority_index,
    r6_sql,
    supplier_index,
)
from tidemark.plans.registry import query, rounded
from tidemark.plans.sqltests import adf_steps, critical_sql, grid_steps, p_value_steps


def _report_sql(extra="series_id"):
    return f"""SELECT {extra}, {r6_sql('stat')} AS stat, {r6_sql('p_value')} AS p_value,
  cast(used_lag AS int) AS used_lag, n_obs, {critical_sql('n_obs')},
  (stat <= -2.86154 - 2.8903 / n_obs - 4.234 / pow(n_obs, 2) - 40.04 / pow(n_obs, 3)
   OR p_value <= 0.05) AS stationary FROM p_values"""


def _report(rows):
    shown = rounded(rows, "stat", "p_value", "crit_1", "crit_5", "crit_10")
    return shown.drop("status")


@query(f"""WITH {PRIORITY_INDEX_SQL}, steps AS (
    SELECT series_id, y - lag(y) OVER o AS dy, lag(y) OVER o AS prev FROM levels
    WINDOW o AS (PARTITION BY series_id ORDER BY ds)), fitted AS (
    SELECT series_id, 0 AS used_lag, count(*) AS n_obs, regr_slope(dy, prev) / sqrt(
      (regr_syy(dy, prev) - pow(regr_sxy(dy, prev), 2) / regr_sxx(dy, prev))
      / (count(*) - 2) / regr_sxx(dy, prev)) AS stat
    FROM steps WHERE dy IS NOT NULL GROUP BY series_id), {p_value_steps('fitted')}
  {_report_sql()}""")
def adf_lag0(spark, sf_dir):
    return _report(adf(priority_index(spark, sf_dir), KEY, autolag=None, maxlag=0))


@query(f"WITH {PRIORITY_INDEX_SQL}, {adf_steps('levels')} {_report_sql()}")
def adf_autolag(spark, sf_dir):
    return _report(adf(priority_index(spark, sf_dir), KEY))


@query(f"WITH {SUPPLIER_INDEX_SQL}, {adf_steps('levels')} {_report_sql()}")
def adf_suppliers(spark, sf_dir):
    """The test on one series per supplier."""
    return _report(adf(supplier_index(spark, sf_dir), KEY))


@query(f"""WITH {WEEKLY_SQL}, sizes AS (SELECT series_id, count(*) AS n FROM weekly GROUP BY 1)
  SELECT series_id, n, {critical_sql('n')} FROM sizes""")
def adf_critical(spark, sf_dir):
    sizes = panel(spark, sf_dir).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return rounded(sizes.withColumns(critical_values("n")), "crit_1", "crit_5", "crit_10")


STAGES_SQL = f"""{PRIORITY_INDEX_SQL}, stages AS (
  SELECT series_id || '/level' AS k, ds, exp(y) AS y FROM levels UNION ALL
  SELECT series_id || '/log', ds, ln(exp(y)) FROM levels UNION ALL
  SELECT * FROM (SELECT series_id || '/log_diff', ds, ln(exp(y)) - lag(ln(exp(y))) OVER (
    PARTITION BY series_id ORDER BY ds) AS y FROM levels) WHERE y IS NOT NULL),
{adf_steps('stages', 'k')}, rolled AS (
  SELECT k, avg(y) OVER f AS m, stddev_samp(y) OVER f AS s, count(y) OVER f AS c FROM stages
  WINDOW f AS (PARTITION BY k ORDER BY ds ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
ranges AS (SELECT k, min(m) AS ml, max(m) AS mh, min(s) AS sl, max(s) AS sh
  FROM rolled WHERE c = 52 GROUP BY k)"""


@query(f"""WITH {STAGES_SQL}, reports AS ({_report_sql('k')})
  SELECT split_part(k, '/', 1) AS series_id, split_part(k, '/', 2) AS stage, r.* EXCLUDE (k),
    {r6_sql('ml')} AS rolling_mean_low, {r6_sql('mh')} AS rolling_mean_high,
    {r6_sql('sl')} AS rolling_std_low, {r6_sql('sh')} AS rolling_std_high
  FROM reports r JOIN ranges USING (k)""", name="stationarity_report")
def stationarity_of_stages(spark, sf_dir):
    """The report on the index, its log and its log difference."""
    found = _report(stationarity_report(exp(priority_index(spark, sf_dir)), KEY))
    return rounded(found, "rolling_mean_low", "rolling_mean_high", "rolling_std_low",
                   "rolling_std_high")


FULL_GRID = (range(5), range(3), range(5))
CLOSED_GRID = (range(2), range(3), range(1))
GRID_SQL = f"WITH {PRIORITY_INDEX_SQL}, {grid_steps('levels', *FULL_GRID)}"
SUPPLIER_GRID_SQL = f"WITH {SUPPLIER_INDEX_SQL}, {grid_steps('levels', *FULL_GRID)}"
CLOSED_SQL = f"WITH {PRIORITY_INDEX_SQL}, {grid_steps('levels', *CLOSED_GRID)}"
SCORES_SQL = f"SELECT series_id, p, d, q, n, {r6_sql('rmse')} AS rmse FROM grid"
BEST_SQL = f"""SELECT * EXCLUDE (spot) REPLACE ({r6_sql('rmse')} AS rmse) FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse NULLS LAST, p, d, q) AS spot
  FROM grid WHERE rmse IS NOT NULL) WHERE spot = 1"""


def _grid(rows, ranges=FULL_GRID):
    return grid_search(rows, KEY, p=ranges[0], d=ranges[1], q=ranges[2])


@query(f"{GRID_SQL} {SCORES_SQL}")
def grid_search_rmse(spark, sf_dir):
    """All 75 orders on every series."""
    return rounded(_grid(priority_index(spark, sf_dir)), "rmse").drop("status")


@query(f"{CLOSED_SQL} {SCORES_SQL}")
def grid_search_closed(spark, sf_dir):
    return rounded(_grid(priority_index(spark, sf_dir), CLOSED_GRID), "rmse").drop("status")


@query(f"{GRID_SQL} {BEST_SQL}", name="best_order")
def best_order_per_series(spark, sf_dir):
    found = best_order(_grid(priority_index(spark, sf_dir)), KEY)
    return rounded(found, "rmse").drop("status")


@query(f"{SUPPLIER_GRID_SQL} {BEST_SQL}")
def best_order_suppliers(spark, sf_dir):
    """The best of 75 orders for every supplier."""
    found = best_order(_grid(supplier_index(spark, sf_dir)), KEY)
    return rounded(found, "rmse").drop("status")
