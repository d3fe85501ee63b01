"""Logs, differences and rolling statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import in_time
from tidemark.operators.blocks import over_blocks


def log(df: DataFrame, y: str = "y", out: str | None = None) -> DataFrame:
    """Natural log; a value that is zero or negative gives NULL."""
    return df.withColumn(out or y, F.ln(F.col(y)))


def exp(df: DataFrame, y: str = "y", out: str | None = None) -> DataFrame:
    return df.withColumn(out or y, F.exp(F.col(y)))


def forecast_base(y: str, d: int, window) -> Column:
    """What must be added to a ``d``-fold difference to get the level back:
    a combination of the previous actual levels."""
    if d == 0:
        return F.lit(0.0)
    before = F.lag(y, 1).over(window)
    if d == 1:
        return before
    if d == 2:
        return 2 * before - F.lag(y, 2).over(window)
    raise ValueError("d is 0, 1 or 2")


def _windowed(df, by, ds, block_rows, carried, columns) -> DataFrame:
    if block_rows:
        return over_blocks(df, by, ds, block_rows, carried, columns)
    return df.withColumns(columns(in_time(by, ds)))


def difference(df: DataFrame, by, y: str = "y", d: int = 1, out: str = "w",
               ds: str = "ds", block_rows: int | None = None) -> DataFrame:
    """``d``-fold difference by row position; the first ``d`` rows get NULL.

    Here and below, ``block_rows`` cuts each series into blocks of so many rows, so that a very long
    one is the work of several tasks; without it a series is handled by one.
    """
    return _windowed(df, by, ds, block_rows, d,
                     lambda window: {out: F.col(y) - forecast_base(y, d, window)})


def integrate(df: DataFrame, by, w: str, d: int, y: str = "y", out: str = "level",
              ds: str = "ds", block_rows: int | None = None) -> DataFrame:
    """Turn a (forecast of a) ``d``-fold difference back into a level, using the
    actual earlier levels in ``y``."""
    return _windowed(df, by, ds, block_rows, d,
                     lambda window: {out: F.col(w) + forecast_base(y, d, window)})


def rolling(df: DataFrame, by, y: str = "y", window: int = 52,
            stats: Iterable[str] = ("mean", "std"), ds: str = "ds",
            block_rows: int | None = None) -> DataFrame:
    """Trailing mean and sample standard deviation over ``window`` rows, NULL
    until the frame holds ``window`` values."""
    known = {"mean": F.avg, "std": F.stddev_samp}

    def columns(series):
        frame = series.rowsBetween(1 - window, 0)
        full = F.count(y).over(frame) == window
        return {f"rolling_{s}": F.when(full, known[s](y).over(frame)) for s in stats}

    return _windowed(df, by, ds, block_rows, window - 1, columns)
