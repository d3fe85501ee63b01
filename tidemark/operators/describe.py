"""Summary statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import keys, number, same_key
from tidemark.operators.evaluate import stack
from tidemark.operators.quantiles import counted, selected, sketches
from tidemark.operators.resample import mean_of
from tidemark.sources.writers import scratch_path

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def group_mean(df: DataFrame, by, y: str = "y", out: str = "mean_y",
               places: int | None = None) -> DataFrame:
    """Mean of ``y`` per group; ``places`` as in ``resample``."""
    return df.groupBy(*keys(by)).agg(mean_of(df, y, places).alias(out))


def describe(df: DataFrame, cols: Iterable[str] | None = None, by=None, quartiles: bool = False,
             approx: bool = False) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum, a row per column (of
    all numeric and text columns unless named).

    Text columns are summarised too: ``min_text``/``max_text`` hold their extremes
    and the numeric statistics cover the values that read as numbers.
    ``quartiles`` adds 25/50/75 % with linear interpolation, exact by default;
    ``approx`` takes them from a bounded sketch instead.
    """
    by = keys(by)
    if cols is None:
        kinds = (T.NumericType, T.StringType)
        cols = [f.name for f in df.schema if f.name not in by and isinstance(f.dataType, kinds)]
    else:
        cols = keys(cols)
    if quartiles and not approx:
        return _exact(df, cols, by)
    basic = _basic(df, cols, by)
    if not quartiles:
        return basic
    parts = _approximate(df, cols, by)
    joined = basic.alias("b").join(
        parts.alias("q"), same_key("b", "q", [*by, "column"]), "left"
    )
    return joined.select("b.*", *[f"q.{c}" for c in QUARTILES])


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _value(df: DataFrame, c: str):
    if _is_text(df, c):
        # A failed cast is slow, so text that cannot start a number is not tried.
        read = F.when(F.col(c).rlike(r"^\s*[-+.0-9Ii]"), F.col(c).try_cast("double"))
        return F.when(~F.isnan(read), read)
    return number(F.col(c))


def _basic(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    # Extremes of text cannot be kept in a hash aggregate, so text columns go apart.
    text = [c for c in cols if _is_text(df, c)]
    rest = [c for c in cols if c not in text]
    return stack(*[_summary(df, some, by) for some in (rest, text) if some])


def _summary(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    values = df.select(*by, *cols, *[_value(df, c).alias(f"_value_{c}") for c in cols])
    rows = F.array(*_statistics(df, cols))
    return values.groupBy(*by).agg(rows.alias("_rows")).select(*by, F.inline("_rows"))


def _statistics(df: DataFrame, cols: list[str]) -> list[Column]:
    """A row of aggregates per column, whose values are in ``_value_<column>``."""
    rows = []
    for c in cols:
        v, text = F.col(f"_value_{c}"), _is_text(df, c)
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(c if text else v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                (F.min(c) if text else F.lit(None).cast("string")).alias("min_text"),
                (F.max(c) if text else F.lit(None).cast("string")).alias("max_text"),
            )
        )
    return rows


def _long(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), _value(df, c).alias("value")) for c in cols]
    return df.select(*by, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def _approximate(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    aggs = [F.percentile_approx("value", p, 10_000).alias(c) for c, p in QUARTILES.items()]
    return _long(df, cols, by).groupBy(*by, "column").agg(*aggs)


def _exact(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """All statistics with exact quartiles, in two scans of the table (see ``quantiles``).

    The first is written, one row per group: it holds the statistics and the bounds that the
    second goes by. A table without groups has one row of them, which comes to the driver.
    """
    spark, shares = df.sparkSession, list(QUARTILES.values())
    named = {c: _value(df, c) for c in cols}
    rows = df.select(*by, *cols, *[v.alias(f"_value_{c}") for c, v in named.items()])
    values = {c: F.col(f"_value_{c}") for c in cols}
    first = rows.groupBy(*by).agg(F.array(*_statistics(df, cols)).alias("_rows"),
                                  *[s.alias(n) for n, s in sketches(values, shares).items()])
    path = scratch_path(spark, "describe")
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    names = [f"_bounds{i}" for i in range(len(cols))]
    if by:
        # Groups with many rows are split over tasks by the skew join.
        seen = rows.alias("v").join(first.select(*by, *names).alias("b"), same_key("v", "b", by))
        seen = seen.select(*[F.col(f"v.{c}").alias(c) for c in by], *[
            F.col(f"b.{n}").alias(n) for n in names], *[f"v._value_{c}" for c in cols])
        bounds = [F.col(n) for n in names]
    else:
        seen, row = rows, first.select(*names).first()
        bounds = [_literal(row[n]) for n in names]
    found = selected(counted(seen, by, values, bounds, shares), by, shares)
    column = F.get(F.array(*[F.lit(c) for c in cols]), F.col("c"))
    parts = found.select(*by, column.alias("column"),
                         *[F.col("quantiles")[k].alias(n) for k, n in enumerate(QUARTILES)])
    basic = first.select(*by, F.inline("_rows"))
    joined = basic.alias("b").join(parts.alias("q"), same_key("b", "q", [*by, "column"]), "left")
    return joined.select("b.*", *[f"q.{c}" for c in QUARTILES])


def _literal(bounds) -> Column:
    """The bounds of a column as constants."""
    at = [F.lit(x).cast("double") for x in bounds["at"] or []]
    return F.struct(
        (F.array(*at) if at else F.array().cast("array<double>")).alias("at"),
        F.lit(bounds["n"]).alias("n"), F.lit(bounds["low"]).cast("double").alias("low"),
        F.lit(bounds["high"]).cast("double").alias("high"))
