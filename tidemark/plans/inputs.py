"""Panels made from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import ROWS_BEFORE, in_time, whole_series
from tidemark.operators.resample import resample
from tidemark.operators.series import to_series

KEY = "series_id"
CENTS = 2  # decimals of all amounts of money


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as dated values of their priority."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", KEY)
    return to_series(orders, KEY, "o_orderdate", "o_totalprice")


def panel(spark: SparkSession, sf_dir: str, freq: str = "W", gaps: str = "drop") -> DataFrame:
    """Mean order total per priority and week (or day)."""
    return resample(order_values(spark, sf_dir), KEY, freq=freq, gaps=gaps, places=CENTS)


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean line price per supplier and week: as many series as suppliers."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", KEY)
    prices = to_series(lines, KEY, "l_shipdate", "l_extendedprice")
    return resample(prices, KEY, freq="W", places=CENTS)


def log_index(rows: DataFrame) -> DataFrame:
    """The log of a price-like index of each series: the running sum of its
    centred logs, starting near log 1000."""
    centred = rows.withColumn("_c", F.ln("y") - F.avg(F.ln("y")).over(whole_series(KEY)))
    run = in_time(KEY).rowsBetween(ROWS_BEFORE[0], 0)
    return centred.select(KEY, "ds", (F.ln(F.lit(1000.0)) + F.sum("_c").over(run)).alias("y"))


def priority_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_index(panel(spark, sf_dir))


def supplier_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_index(supplier_panel(spark, sf_dir))


def week_end_sql(day: str) -> str:
    return f"cast({day} + ((7 - isodow({day})) % 7) * interval 1 day as date)"


def mean_sql(y: str) -> str:
    return f"cast(sum(cast({y} as decimal(18,2))) as double) / count({y})"


DAY_SQL = "cast(o_orderdate as date)"
DAILY_SQL = f"""daily AS (
  SELECT o_orderpriority AS series_id, {DAY_SQL} AS ds, {mean_sql('o_totalprice')} AS y
  FROM orders GROUP BY 1, 2)"""
WEEKLY_SQL = f"""weekly AS (
  SELECT o_orderpriority AS series_id, {week_end_sql(DAY_SQL)} AS ds,
         {mean_sql('o_totalprice')} AS y
  FROM orders GROUP BY 1, 2)"""
SUPPLIER_SQL = f"""weekly AS (
  SELECT l_suppkey AS series_id, {week_end_sql('cast(l_shipdate as date)')} AS ds,
         {mean_sql('l_extendedprice')} AS y
  FROM lineitem GROUP BY 1, 2)"""
LOG_INDEX_SQL = """levels AS (
  SELECT series_id, ds, ln(1000.0::double) + sum(c) OVER (PARTITION BY series_id ORDER BY ds
         ROWS UNBOUNDED PRECEDING) AS y
  FROM (SELECT series_id, ds, ln(y) - avg(ln(y)) OVER (PARTITION BY series_id) AS c FROM weekly))"""
PRIORITY_INDEX_SQL = f"{WEEKLY_SQL}, {LOG_INDEX_SQL}"
SUPPLIER_INDEX_SQL = f"{SUPPLIER_SQL}, {LOG_INDEX_SQL}"


def r6_sql(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0::double"
