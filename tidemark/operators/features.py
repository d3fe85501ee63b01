"""Regressors for the additive model, and future rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import in_time, keys


def fourier(df: DataFrame, ds: str = "ds", period: float = 365.25, k: int = 10,
            out: str = "fourier") -> DataFrame:
    """Add the array ``[sin 1, cos 1, ..., sin k, cos k]`` of a seasonality with
    ``period`` days, counted from 1970-01-01."""
    return df.withColumn(out, fourier_terms(ds, period, k))


def fourier_terms(ds: str, period: float, k: int) -> Column:
    day = F.datediff(F.col(ds), F.lit("1970-01-01").cast("date"))
    angle = F.lit(2 * math.pi / period) * day
    return F.array(*[f(angle * i) for i in range(1, k + 1) for f in (F.sin, F.cos)])


def hinges(df: DataFrame, t: str, knots: str | list[float], out: str = "hinges") -> DataFrame:
    """Add the array ``max(t - knot, 0)``; ``knots`` is a list or an array column."""
    spots = F.col(knots) if isinstance(knots, str) else F.array(*[F.lit(float(s)) for s in knots])
    return df.withColumn(out, F.transform(spots, lambda s: F.greatest(F.col(t) - s, F.lit(0.0))))


def holiday_days(holidays: DataFrame) -> DataFrame:
    """Every day touched by a holiday: ``holiday``, ``offset`` and ``ds``.

    ``holidays`` has ``holiday``, ``ds``, ``lower_window`` and ``upper_window``;
    offset -1 is the day before, and so on.
    """
    spread = holidays.select(
        "holiday", F.to_date("ds").alias("_day"),
        F.explode(F.sequence("lower_window", "upper_window")).alias("offset"),
    )
    return spread.select("holiday", "offset", F.date_add("_day", F.col("offset")).alias("ds"))


def holiday_flags(df: DataFrame, holidays: DataFrame, ds: str = "ds") -> DataFrame:
    """Rows of ``df`` that fall on a holiday or in its window, a row per holiday
    and offset (other rows once, with NULLs)."""
    days = holiday_days(holidays).distinct()
    same = F.to_date(F.col(f"a.{ds}")) == F.col("h.ds")
    return df.alias("a").join(days.alias("h"), same, "left").select("a.*", "h.holiday", "h.offset")


def future_frame(df: DataFrame, by, periods: int, ds: str = "ds") -> DataFrame:
    """The dates of every series followed by ``periods`` further days."""
    last = F.lead(ds).over(in_time(by, ds)).isNull()
    rows = df.select(*keys(by), ds).withColumn("_last", last)
    onward = F.sequence(F.col(ds), F.date_add(ds, periods))
    days = F.when(F.col("_last"), onward).otherwise(F.array(ds))
    return rows.select(*keys(by), F.explode(days).alias("_ds"), F.col(ds).alias("_from")).select(
        *keys(by), F.col("_ds").alias(ds), (F.col("_ds") > F.col("_from")).alias("is_future")
    )
