"""Panels laid out by month, so that a span of time is read without the rest."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import day_of

MONTH = "month"


def write_panel(df: DataFrame, path: str, ds: str = "ds", mode: str = "error") -> None:
    """One folder per month of ``ds`` (rows without a date in one of their own). Rows are
    range-partitioned by date and a hash of the row first: a month becomes few files, and one
    that holds much of the table several."""
    if MONTH in df.columns:
        raise ValueError(f"a column is named {MONTH}")
    laid = df.withColumn(MONTH, F.date_format(day_of(df, ds), "yyyy-MM"))
    laid.repartitionByRange(MONTH, F.xxhash64(*df.columns)).write.partitionBy(MONTH).mode(mode).parquet(path)


def read_panel(spark: SparkSession, path: str, ds: str = "ds", start: date | None = None,
               end: date | None = None) -> DataFrame:
    """The rows from ``start`` to ``end`` (both included; either may be left out). Months outside
    are not listed for reading."""
    rows = spark.read.option("basePath", path).schema(_schema(spark, path)).parquet(path)
    if start is not None:
        rows = rows.where((F.col(MONTH) >= f"{start:%Y-%m}") & (day_of(rows, ds) >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col(MONTH) <= f"{end:%Y-%m}") & (day_of(rows, ds) <= F.lit(end)))
    return rows.drop(MONTH)


def _schema(spark: SparkSession, path: str) -> str:
    """The stored columns, the month as text (it would be read as a date)."""
    kept = spark.read.parquet(path).drop(MONTH)
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"{MONTH} string"])
