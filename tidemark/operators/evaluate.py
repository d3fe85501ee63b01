"""Scores, comparison tables and chart-ready frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import keys, ratio, same_key


def _errors(y: str, yhat: str) -> tuple[Column, Column]:
    """The error and the actual value of a scored row, NULL on other rows."""
    scored = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    return F.when(scored, F.col(y) - F.col(yhat)), F.when(scored, F.col(y))


def _r2(miss: Column, actual: Column) -> Column:
    return 1 - ratio(F.avg(miss * miss), F.var_pop(actual))


def score(df: DataFrame, by, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """``n``, ``n_missing``, ``mse``, ``rmse`` and ``r2`` of forecasts per series.

    Rows without a forecast or an actual value are counted in ``n_missing``.
    ``r2`` compares with the mean of the scored actual values.
    """
    miss, actual = _errors(y, yhat)
    return df.groupBy(*keys(by)).agg(
        F.count(miss).alias("n"),
        F.count_if(miss.isNull()).alias("n_missing"),
        F.avg(miss * miss).alias("mse"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        _r2(miss, actual).alias("r2"),
    )


def predicted_vs_expected(df: DataFrame, by, y: str = "y", yhat: str = "yhat",
                          ds: str = "ds") -> DataFrame:
    """Forecasts of a log series next to the actual values, both on the level."""
    return df.select(
        *keys(by), ds, F.exp(yhat).alias("predicted"), F.exp(y).alias("expected")
    )


def compare(forecasts: DataFrame, by, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Model comparison: a score per series and order, from forecasts of a log
    series.  ``rmse_log`` and ``r2_log`` are on the log scale, ``r2_level`` is on
    the level."""
    miss_log, actual_log = _errors(y, yhat)
    levels = forecasts.withColumns({"_y": F.exp(y), "_yhat": F.exp(yhat)})
    miss, actual = _errors("_y", "_yhat")
    return levels.groupBy(*keys(by), "p", "d", "q", "const").agg(
        F.count(miss_log).alias("n"),
        F.sqrt(F.avg(miss_log * miss_log)).alias("rmse_log"),
        _r2(miss_log, actual_log).alias("r2_log"),
        _r2(miss, actual).alias("r2_level"),
    )


def align(a: DataFrame, b: DataFrame, on: Iterable[str]) -> DataFrame:
    """Two tables side by side on the key, keeping the rows of both; NULL keys meet."""
    on = keys(on)
    joined = a.alias("a").join(b.alias("b"), same_key("a", "b", on), "full")
    return joined.select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in on],
        *[f"a.{c}" for c in a.columns if c not in on], *[f"b.{c}" for c in b.columns if c not in on])


def stack(*tables: DataFrame) -> DataFrame:
    """Tables below one another, matched by column name; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def plot_frame(df: DataFrame, by, panels: Mapping[str, str], ds: str = "ds") -> DataFrame:
    """Long frame ``(keys, ds, panel, value)`` for a chart: ``panels`` maps the
    name of a panel to the column it shows."""
    pairs = [
        F.struct(F.lit(name).alias("panel"), F.col(c).cast("double").alias("value"))
        for name, c in panels.items()
    ]
    return df.select(*keys(by), ds, F.inline(F.array(*pairs)))
