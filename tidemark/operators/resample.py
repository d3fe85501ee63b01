"""Daily and weekly means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import day_of, in_time, keys, ratio, units, week_end

STEP_DAYS = {"D": 1, "W": 7}


def mean_of(df: DataFrame, y: str, places: int | None = None) -> Column:
    """Mean as a double.  Decimals, and values with a known number of ``places``,
    are summed exactly first; the latter in longs, which is much the faster."""
    if places is not None:
        total = F.sum(units(F.col(y), places)).cast("double") / F.lit(10.0**places)
    elif isinstance(df.schema[y].dataType, T.DecimalType):
        total = F.sum(y).cast("double")
    else:
        return F.avg(y)
    return ratio(total, F.count(y).cast("double"))


def resample(df: DataFrame, by, ds: str = "ds", y: str = "y", freq: str = "D",
             gaps: str = "drop", places: int | None = None) -> DataFrame:
    """Mean of ``y`` per day (``D``) or per week ending on Sunday (``W``).

    ``gaps='drop'`` leaves out empty buckets; ``gaps='keep'`` returns every
    bucket between the first and the last of the series, empty ones with NULL.
    ``places`` is the number of decimals of the values, if they have one: sums are
    then exact and do not depend on the order in which tasks deliver their rows.

    The sums are combined on the map side, so what is shuffled per key is at
    most one row per bucket and task, however many rows the key has.  The result
    has at most one row per key and bucket: later windows over a series are
    bounded by the calendar.
    """
    if freq not in STEP_DAYS or gaps not in ("drop", "keep"):
        raise ValueError("freq is D or W, gaps is drop or keep")
    day = day_of(df, ds)
    bucket = day if freq == "D" else week_end(day)
    means = df.groupBy(*keys(by), bucket.alias("ds")).agg(mean_of(df, y, places).alias("y"))
    if gaps == "drop":
        return means.where(F.col("y").isNotNull())
    return fill_calendar(means, by, freq=freq)


def bucket_sums(df: DataFrame, by, places: int, ds: str = "ds", y: str = "y",
                freq: str = "D") -> DataFrame:
    """The state of ``resample`` before its last step: per bucket ``total``, the exact sum in units
    of the last of ``places`` decimals, and ``held``, the number of values. States can be summed
    again by any coarser key, after a join, say, that tells which series a row belongs to."""
    day = day_of(df, ds)
    bucket = day if freq == "D" else week_end(day)
    return df.groupBy(*keys(by), bucket.alias("ds")).agg(
        F.sum(units(F.col(y), places)).alias("total"), F.count(y).alias("held"))


def means_of_sums(sums: DataFrame, by, places: int, freq: str = "D", gaps: str = "drop") -> DataFrame:
    """The means that ``resample`` gives, from states of ``bucket_sums`` that carry the key."""
    added = sums.groupBy(*keys(by), "ds").agg(F.sum("total").alias("_total"), F.sum("held").alias("_held"))
    mean = ratio(F.col("_total").cast("double") / F.lit(10.0**places), F.col("_held").cast("double"))
    means = added.select(*keys(by), "ds", mean.alias("y"))
    if gaps == "drop":
        return means.where(F.col("y").isNotNull())
    return fill_calendar(means, by, freq=freq)


def fill_calendar(df: DataFrame, by, freq: str = "D", ds: str = "ds", y: str = "y") -> DataFrame:
    """Insert the missing buckets of a regular series with a NULL value.

    Each row is repeated forward up to the next one, so no join with a calendar
    is needed and the rows stay partitioned by series.
    """
    step = STEP_DAYS[freq]
    following = F.lead(ds).over(in_time(by, ds))
    until = F.coalesce(F.date_sub(following, step), F.col(ds))
    spread = df.withColumn("_until", until).withColumn(
        "_at", F.explode(F.sequence(F.col(ds), F.col("_until"), F.expr(f"interval {step} days")))
    )
    return spread.select(
        *keys(by),
        F.col("_at").alias("ds"),
        F.when(F.col("_at") == F.col(ds), F.col(y)).alias("y"),
    )
