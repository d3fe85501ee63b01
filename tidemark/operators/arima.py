"""ARIMA(p,d,q) by two-stage least squares over expanding windows.

The estimator is that of Hannan and Rissanen (1982) in recursive form:

1. ``w`` is the ``d``-fold difference of the series.
2. With moving-average terms, ``w`` is regressed on its own last ``m`` values over
   the rows before ``t``; what that misses at ``t`` is the innovation ``e``.
3. ``w`` is regressed on ``p`` lags of ``w`` and ``q`` lags of ``e``, again over the
   rows before ``t``, and predicted at ``t``.

Each regression needs only running sums of products, so a refit at every origin
costs one window pass and the forecast at ``t`` cannot see ``t`` or later.  The
coefficients differ from exact maximum likelihood, mostly for short histories and
moving-average roots near one.

All windows share the key and the order of the series, so the whole chain takes
one shuffle.  One series is handled by one task; after ``resample`` its length is
bounded by the calendar (a century of days is 36,525 rows).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.batches import keyed_schema
from tidemark.functions.columns import ROWS_BEFORE, in_time, keys
from tidemark.functions.linalg import PIVOT_FLOOR, leading_predictions, square, stacked
from tidemark.operators.resample import STEP_DAYS
from tidemark.operators.series import drop_missing
from tidemark.operators.series import split as split_rows
from tidemark.operators.transforms import forecast_base

MIN_ROWS = 10
COLUMN_SOLVE = 4  # up to this many regressors are solved by column arithmetic


def burn_in(k: int) -> int:
    """Rows needed before a regression on ``k`` regressors is used."""
    return max(MIN_ROWS, 2 * k)


def walk_forward(df: DataFrame, by, y: str = "y", order=(1, 1, 0), const: bool = True,
                 split: float = 0.7, ds: str = "ds", long_lags: int | None = None) -> DataFrame:
    """One-step forecasts of the test part of every series.

    At each test row the model is fitted to all actual values before it.
    ``order`` is one ``(p, d, q)`` or a list of them, which share the same pass
    over the data.  Returns the key columns, ``ds``, ``y``, ``yhat``, ``p``, ``d``,
    ``q``, ``const`` and ``status``: ``ok``, ``short`` (too little history) or
    ``singular`` (collinear regressors), ``yhat`` being NULL in the last two.

    ``long_lags`` is the number of lags in the first stage, ``max(p, q)`` unless given.
    """
    orders = [order] if isinstance(order[0], int) else list(order)
    rows = split_rows(drop_missing(df, y), by, frac=split, ds=ds)
    cells = []
    for i, one in enumerate(orders):
        rows = _forecast(rows, by, y, one, const, ds, long_lags)
        rows = rows.withColumnsRenamed({"yhat": f"_yhat{i}", "status": f"_status{i}"})
        cells.append([F.col(f"_yhat{i}").alias("yhat"), *_order_columns(one, const),
                      F.col(f"_status{i}").alias("status")])
    tested = rows.where("is_test")
    if len(cells) == 1:
        return tested.select(*keys(by), ds, y, *cells[0])
    return tested.select(*keys(by), ds, y, F.inline(F.array(*[F.struct(*c) for c in cells])))


def forecast_next(df: DataFrame, by, y: str = "y", order: tuple[int, int, int] = (1, 1, 0),
                  const: bool = True, freq: str = "D", ds: str = "ds",
                  long_lags: int | None = None) -> DataFrame:
    """The forecast for the step after the last row of every series."""
    last = F.lead(ds).over(in_time(by, ds)).isNull()
    rows = drop_missing(df, y).select(*keys(by), ds, y).withColumn("_last", last)
    here = F.struct(F.col(ds).alias("_ds"), F.col(y).alias("_y"), F.lit(False).alias("_ahead"))
    after = F.struct(
        F.date_add(ds, STEP_DAYS[freq]).alias("_ds"),
        F.lit(None).cast(rows.schema[y].dataType).alias("_y"),
        F.lit(True).alias("_ahead"),
    )
    grown = rows.select(
        *keys(by), F.inline(F.when(F.col("_last"), F.array(here, after)).otherwise(F.array(here)))
    ).withColumnsRenamed({"_ds": ds, "_y": y})
    fitted = _forecast(grown, by, y, order, const, ds, long_lags)
    return fitted.where("_ahead").select(
        *keys(by), ds, "yhat", *_order_columns(order, const), "status"
    )


def _order_columns(order, const) -> list[Column]:
    named = [F.lit(v).cast("int").alias(c) for c, v in zip("pdq", order)]
    return [*named, F.lit(const).alias("const")]


def _forecast(df, by, y, order, const, ds, long_lags) -> DataFrame:
    p, d, q = order
    window = in_time(by, ds)
    level = F.col(y).cast("double")
    base = forecast_base(y, d, window).cast("double")
    if d == 0 and const:
        # A constant absorbs any shift; measuring from the first value keeps the sums small.
        base = F.first(y).over(window.rowsBetween(*ROWS_BEFORE)).cast("double")
        base = F.coalesce(base, level)
    rows = df.withColumn("_base", base).withColumn("_w", level - F.col("_base"))
    if q:
        rows = _with_innovations(rows, window, long_lags or max(p, q), const)
    lags = [F.lag("_w", i).over(window) for i in range(1, p + 1)]
    lags += [F.lag("_e", i).over(window) for i in range(1, q + 1)]
    rows = _expanding_fit(rows, window, lags, const)
    return rows.withColumns({
        "yhat": F.col("_fit") + F.col("_base"),
        "status": F.when(F.col("_fit").isNotNull() & F.col("_base").isNotNull(), "ok")
        .when(F.col("_ready"), "singular")
        .otherwise("short"),
    }).drop("_base", "_w", "_e", "_fit", "_ready")


def _with_innovations(rows, window, m, const) -> DataFrame:
    lags = [F.lag("_w", i).over(window) for i in range(1, m + 1)]
    fitted = _expanding_fit(rows, window, lags, const)
    return fitted.withColumn("_e", F.col("_w") - F.col("_fit")).drop("_fit", "_ready")


def _expanding_fit(rows: DataFrame, window, regressors: Sequence[Column], const: bool) -> DataFrame:
    """Add ``_fit``: the prediction of ``_w`` from the regressors, fitted to the
    rows before.  ``_ready`` tells whether there were enough of them."""
    k = len(regressors)
    kept = [c for c in rows.columns if c not in ("_ready", "_fit")]
    before = window.rowsBetween(*ROWS_BEFORE)
    rows = _complete_cases(rows, regressors)
    ready = F.count("_t").over(before) >= burn_in(k + const)
    size = k + const
    if k == 0:
        fit, sums = (F.avg("_t").over(before), {}) if const else (F.lit(0.0), {})
        rows = rows.withColumn("_ready", ready if const else F.lit(True))
    elif k == 1 and const:
        sums = {"_slope": F.regr_slope("_t", "_z0").over(before),
                "_level": F.regr_intercept("_t", "_z0").over(before)}
        fit = F.col("_level") + F.col("_slope") * F.col("_x0")
        rows = rows.withColumns({"_ready": ready, **sums})
    else:
        sums = _products(k, const, before)
        rows = rows.withColumns({"_ready": ready, **sums})
        if size <= COLUMN_SOLVE:
            rows, fit = _eliminate(rows, k, const)
        else:
            fit = _batched_fit(size, const)(
                F.array(*sums), F.array(*[F.col(f"_x{i}") for i in range(k)])
            )
    return rows.select(*kept, "_ready", F.when(F.col("_ready"), fit).alias("_fit"))


def _complete_cases(rows: DataFrame, regressors: Sequence[Column]) -> DataFrame:
    """Add the regressors ``_x<i>`` and, on rows where they and ``_w`` are all known,
    the copies ``_z<i>`` and ``_t`` that enter the sums."""
    names = [f"_x{i}" for i in range(len(regressors))]
    rows = rows.withColumns(dict(zip(names, regressors)))
    usable = " AND ".join(f"{c} IS NOT NULL" for c in ["_w", *names])
    return rows.selectExpr(
        "*", f"IF({usable}, _w, NULL) AS _t",
        *[f"IF({usable}, {n}, NULL) AS _z{i}" for i, n in enumerate(names)],
    )


def _eliminate(rows: DataFrame, k: int, const: bool) -> tuple[DataFrame, Column]:
    """Solve the normal equations of every row with column arithmetic.

    One regressor after another is eliminated from the sums of products and from
    the point of prediction; its share of the prediction is then final.  Later
    expressions refer to earlier ones by name (step, then place).
    """
    size = k + const
    point = (["1.0D"] if const else []) + [f"_x{i}" for i in range(k)]
    steps = [f"{x} AS _v0_{i}" for i, x in enumerate(point)]
    for s in range(size):
        pivot = f"_g{s}_{s}_{s}"
        steps.append(f"CASE WHEN {pivot} > {PIVOT_FLOOR}D * _g0_{s}_{s} THEN 1.0D / {pivot} END "
                     f"AS _share{s}")
        for i in range(s + 1, size):
            part = f"_g{s}_{s}_{i} * _share{s}"
            steps.append(f"_r{s}_{i} - {part} * _r{s}_{s} AS _r{s + 1}_{i}")
            steps.append(f"_v{s}_{i} - {part} * _v{s}_{s} AS _v{s + 1}_{i}")
            steps += [f"_g{s}_{i}_{j} - {part} * _g{s}_{s}_{j} AS _g{s + 1}_{i}_{j}"
                      for j in range(i, size)]
    total = " + ".join(f"_v{s}_{s} * _r{s}_{s} * _share{s}" for s in range(size))
    solved = rows.selectExpr("*", *steps)
    return solved, F.expr(total)


def _products(k: int, const: bool, before) -> dict[str, Column]:
    """Running sums of all products of the regressors and of their products with
    the response; a constant regressor comes first."""
    cols = (["IF(_t IS NULL, NULL, 1.0D)"] if const else []) + [f"_z{i}" for i in range(k)]
    size = len(cols)
    pairs = {f"_g0_{i}_{j}": f"{cols[i]} * {cols[j]}" for i in range(size) for j in range(i, size)}
    pairs |= {f"_r0_{i}": f"{cols[i]} * _t" for i in range(size)}
    return {name: F.expr(f"sum({text})").over(before) for name, text in pairs.items()}


def _batched_fit(size: int, const: bool):
    """The same for more regressors: a vectorised function over batches of rows."""

    @F.pandas_udf(T.DoubleType())
    def fit(known: pd.Series, at: pd.Series) -> pd.Series:
        known, at = stacked(known).T.copy(), stacked(at).T.copy()
        if const:
            at = np.vstack([np.ones(at.shape[1]), at])
        edge = size * (size + 1) // 2
        got = leading_predictions(square(known[:edge], size), known[edge:], at)[-1]
        return pd.Series(got).where(np.isfinite(got), None).astype("Float64")

    return fit


def grid_search(df: DataFrame, by, y: str = "y", p: Sequence[int] = range(5),
                d: Sequence[int] = range(3), q: Sequence[int] = range(5), split: float = 0.5,
                const: bool = False, float32: bool = True, ds: str = "ds") -> DataFrame:
    """RMSE of the walk-forward forecasts of every order, per series.

    All orders with the same ``d`` are fitted on a common sample, the rows where
    every lag up to the largest order exists; each order's normal equations are
    then a part of one set of running sums.  The values of ``d`` are laid out as
    rows, so the whole grid is one pass over the data.

    ``float32`` rounds the series to single precision first.  An order that has
    no forecast for some test row gets ``status = 'failed'`` and no ``rmse``.
    An order without any term is the naive forecast.
    """
    ps, qs = sorted(set(p)), sorted(set(q))
    most_p, most_q = max(ps), max(qs)
    series_keys, window = keys(by), in_time(by, ds)
    level = F.col(y).cast("float").cast("double") if float32 else F.col(y).cast("double")
    rows = split_rows(drop_missing(df, y).withColumn("_y", level), by, frac=split, ds=ds)

    variants = [
        F.struct(F.lit(v).cast("int").alias("d"), base.cast("double").alias("_base"))
        for v, base in ((v, forecast_base("_y", v, window)) for v in sorted(set(d)))
    ]
    rows = rows.withColumn("_variants", F.array(*variants)).select(
        *series_keys, ds, "_y", "is_test", F.inline("_variants")
    ).withColumn("_w", F.col("_y") - F.col("_base"))

    window = Window.partitionBy(*series_keys, "d").orderBy(ds)
    before = window.rowsBetween(*ROWS_BEFORE)
    if most_q:
        rows = _with_innovations(rows, window, max(most_p, most_q), const)
    k = most_p + most_q
    lags = [F.lag("_e", i).over(window) for i in range(1, most_q + 1)]
    lags += [F.lag("_w", i).over(window) for i in range(1, most_p + 1)]
    rows = _complete_cases(rows, lags)
    sums = _products(k, const, before)
    rows = rows.withColumns({"_seen": F.count("_t").over(before), **sums}).where("is_test")
    none = F.array().cast("array<double>")
    rows = rows.select(
        *series_keys, "d", (F.col("_y") - F.col("_base")).alias("_actual"), "_seen",
        (F.array(*sums) if sums else none).alias("_sums"),
        (F.array(*[F.col(f"_x{i}") for i in range(k)]) if k else none).alias("_at"),
    )
    group = [*series_keys, "d"]
    parts = rows.mapInPandas(
        _batch_errors(group, ps, qs, most_p, most_q, const),
        keyed_schema(rows, group, "_rows bigint, _held array<bigint>, _squares array<double>"),
    )
    orders = F.array(*[
        F.struct(F.lit(a).cast("int").alias("p"), F.lit(b).cast("int").alias("q"))
        for b in qs for a in ps
    ])
    cells = parts.select(*group, "_rows", F.posexplode(F.arrays_zip("_held", "_squares")))
    totals = cells.groupBy(*group, "pos").agg(
        F.sum("_rows").alias("n"), F.sum("col._held").alias("held"),
        F.sum("col._squares").alias("squares"),
    )
    whole = F.col("held") == F.col("n")
    order = orders[F.col("pos")]
    return totals.select(
        *series_keys, order["p"].alias("p"), "d", order["q"].alias("q"), "n",
        F.when(whole, F.sqrt(F.col("squares") / F.col("n"))).alias("rmse"),
        F.when(whole, "ok").otherwise("failed").alias("status"),
    )


def _batch_errors(group, ps, qs, most_p, most_q, const):
    """Per batch of rows and group: the number of forecasts of every order and
    their sum of squared errors, for each ``q`` in turn those of every ``p``.

    A forecast is missing where the rows before are too few or the regressors
    collinear.  Regressors are eliminated innovations first, so one elimination
    per ``q`` serves every ``p``.
    """
    size = const + most_p + most_q
    edge = size * (size + 1) // 2

    def predictions(rows: pd.DataFrame) -> np.ndarray:
        known, at = stacked(rows["_sums"]).T.copy(), stacked(rows["_at"]).T.copy()
        seen = rows["_seen"].to_numpy()
        if const:
            at = np.vstack([np.ones(len(rows)), at])
        gram, rhs = square(known[:edge], size), known[edge:]
        columns = []
        for q in qs:
            pick = [*range(const + q), *range(const + most_q, size)]
            steps = leading_predictions(gram[np.ix_(pick, pick)], rhs[pick], at[pick])
            for p in ps:
                terms = const + p + q
                if terms:
                    columns.append(np.where(seen >= burn_in(terms), steps[terms - 1], np.nan))
                else:
                    columns.append(np.zeros(len(rows)))
        return np.column_stack(columns)

    def run(batches):
        for rows in batches:
            if rows.empty:
                continue
            error = rows["_actual"].to_numpy(dtype="float64")[:, None] - predictions(rows)
            there = np.isfinite(error)
            code = rows.groupby(group, dropna=False, sort=False).ngroup().to_numpy()
            first = np.unique(code, return_index=True)[1]
            held = np.zeros((len(first), error.shape[1]), dtype="int64")
            squares = np.zeros(held.shape)
            np.add.at(held, code, there)
            np.add.at(squares, code, np.where(there, error * error, 0.0))
            yield rows[group].iloc[first].assign(
                _rows=np.bincount(code), _held=list(held), _squares=list(squares)
            )

    return run


def best_order(scores: DataFrame, by) -> DataFrame:
    """The order with the lowest ``rmse`` per series; of equals the first in
    (p, d, q) order."""
    rank = F.row_number().over(
        Window.partitionBy(*keys(by)).orderBy(F.col("rmse").asc_nulls_last(), "p", "d", "q")
    )
    ranked = scores.where(F.col("rmse").isNotNull()).withColumn("_rank", rank)
    return ranked.where(F.col("_rank") == 1).drop("_rank")
