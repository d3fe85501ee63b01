"""Long series in blocks of rows, so that one key is the work of many tasks.

A window over a key puts all its rows into one task. Where a result needs only the last few rows,
that is not needed: rows are numbered in two levels (counts per span of days, their running sums, and
places inside a span), cut into blocks by number, and each block carries the last rows of the one
before it. Windows then go by key and block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import day_of, keys, same_key

SPAN_DAYS = 1024


def numbered(df: DataFrame, by, ds: str = "ds") -> DataFrame:
    """Add ``_pos``, the 1-based place of each row of its series, without a window over the series.
    A date may have several rows; those without one come first."""
    by = keys(by)
    day = F.datediff(day_of(df, ds), F.lit("1970-01-01").cast("date"))
    rows = df.withColumn("_span", F.floor(day / SPAN_DAYS))
    group = [*by, "_span"]
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    line = Window.partitionBy(*by).orderBy(F.col("_span").asc_nulls_first())
    before = counts.withColumn("_before", F.sum("_rows").over(line) - F.col("_rows"))
    inside = Window.partitionBy(*group).orderBy(F.col(ds).asc_nulls_first())
    joined = rows.alias("a").join(before.alias("b"), same_key("a", "b", group)).select("a.*", "b._before")
    return joined.withColumn("_pos", F.col("_before") + F.row_number().over(inside)).drop("_before", "_span")


def over_blocks(df: DataFrame, by, ds: str, block_rows: int, carried: int,
                columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Add ``columns(window)``, of which none looks further back than ``carried`` rows, by windows over
    blocks of ``block_rows`` rows (more if ``carried`` asks for it)."""
    size = max(block_rows, 2 * carried)
    block = F.floor((F.col("_pos") - 1) / size)
    late = (F.col("_pos") - 1) % size >= size - carried
    laid = numbered(df, by, ds).withColumn(
        "_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    window = Window.partitionBy(*keys(by), "_block").orderBy("_pos")
    found = laid.withColumns(columns(window))
    own = F.floor((F.col("_pos") - 1) / size) == F.col("_block")
    return found.where(own).drop("_pos", "_block")
