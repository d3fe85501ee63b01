"""Additive decomposition into trend, seasonal and residual parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import WHOLE, in_time, keys, whole_series


def decompose(df: DataFrame, by, y: str = "y", period: int = 52, ds: str = "ds") -> DataFrame:
    """Add ``trend``, ``seasonal``, ``resid`` and ``status``.

    The trend is the centred moving average of length ``period`` (half weights at
    both ends when it is even) and is NULL for half a period at either end.  The
    seasonal part is the mean of ``y - trend`` per position in the cycle, counted
    from the start of the series, centred to mean zero.

    A series with missing values or fewer than two cycles has NULL parts and says
    so in ``status``.  Every window is keyed by the series first, so the data is
    shuffled once.
    """
    order, series = in_time(by, ds), whole_series(by, ds)
    half = period // 2
    span = order.rowsBetween(-half, half)
    if period % 2:
        total = F.sum(y).over(span)
    else:
        inner = F.sum(y).over(order.rowsBetween(1 - half, half - 1))
        ends = F.lag(y, half).over(order) + F.lead(y, half).over(order)
        total = inner + 0.5 * ends
    full = F.count(y).over(span) == 2 * half + 1

    placed = df.withColumns({
        "_pos": F.row_number().over(order),
        "_rows": F.count(F.lit(1)).over(series),
        "_held": F.count(y).over(series),
    })
    status = (
        F.when(F.col("_held") < F.col("_rows"), "missing")
        .when(F.col("_rows") < 2 * period, "short")
        .otherwise("ok")
    )
    trended = placed.withColumns({
        "status": status,
        "_phase": (F.col("_pos") - 1) % period,
        "trend": F.when((status == "ok") & full, total / period),
    })
    cycle = Window.partitionBy(*keys(by), "_phase").orderBy(ds).rowsBetween(*WHOLE)
    averaged = trended.withColumn("_mean", F.avg(F.col(y) - F.col("trend")).over(cycle))
    # Each position occurs exactly once in the first cycle.
    centre = F.avg(F.when(F.col("_pos") <= period, F.col("_mean"))).over(series)
    parts = averaged.withColumn("seasonal", F.col("_mean") - centre)
    return parts.withColumn("resid", F.col(y) - F.col("trend") - F.col("seasonal")).drop(
        "_pos", "_rows", "_held", "_phase", "_mean"
    )
