"""Exact quantiles of large columns by rank selection in two scans.

The first scan takes a sketch (KLL) of every column; around each wanted quantile it gives an interval
that holds it, with under one in a hundred of the rows. The second scan counts: a value is either in
no interval, and adds one to the rows in its gap, or in one, and adds one to the rows with its value.
What is left is small, but may still be large at 10^11 rows, so its running counts are taken in two
levels: it is range-partitioned in the order of the values, each range is counted on its own, and the
totals of the ranges before it are added. No column's values meet in one task.

The margin around a quantile is fourteen times the sketch's standard error. Should a quantile
all the same lie outside its interval, the counts show it, and the query stops with an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import WHOLE, same_key
from tidemark.sources.writers import scratch_path

# Size of the sketch, the margin around a quantile (as a share of the rows), the number of rows up
# to which a column is kept whole, and the columns whose places are counted together.
SKETCH, MARGIN, FEW, TOGETHER = 4_000, 0.004, 2_000, 4


def sketches(values: dict[str, Column], shares: Sequence[float]) -> dict[str, Column]:
    """Aggregates for the first scan, one per column."""
    spots = F.array(*[F.lit(min(max(p + side * MARGIN, 0.0), 1.0))
                      for p in shares for side in (-1, 1)])
    found = {}
    for i, v in enumerate(values.values()):
        sketch = F.call_function("kll_sketch_agg_double", v, F.lit(SKETCH))
        at = F.when(F.count(v) > FEW, F.call_function("kll_sketch_get_quantile_double", sketch, spots))
        found[f"_bounds{i}"] = F.struct(at.alias("at"), F.count(v).alias("n"), F.min(v).alias("low"),
                                        F.max(v).alias("high"))
    return found


def _intervals(bounds: Column, k: int) -> tuple[list[Column], list[Column]]:
    """The ends of the ``k`` intervals; a short column is one interval."""
    few = bounds["n"] <= FEW
    ends = [F.when(few, bounds["low" if j % 2 == 0 else "high"]).otherwise(
        F.get(bounds["at"], F.lit(j))) for j in range(2 * k)]
    return ends[::2], ends[1::2]


def counted(rows: DataFrame, by: list[str], values: dict[str, Column], bounds: list[Column],
            shares: Sequence[float]) -> DataFrame:
    """The second scan: ``*by, c`` (number of the column), ``zone``, ``value``, ``held``. Zones rise
    with the value; one that lies in a gap has no values, only the number of its rows."""
    places = []
    for v, b in zip(values.values(), bounds):
        lows, highs = _intervals(b, len(shares))
        inside, zone = F.lit(False), F.lit(0)
        for low, high in zip(lows, highs):
            inside = inside | ((v >= low) & (v <= high))
            zone = zone + F.when(v >= low, 1).otherwise(0) + F.when(v > high, 1).otherwise(0)
        places.append((F.when(v.isNotNull(), zone), F.when(inside, v)))
    # The places of a few columns are counted together first: most rows lie in gaps, of which there
    # are few combinations, so that few of them are laid out by column.
    parts = []
    for i in range(0, len(places), TOGETHER):
        cells = [x for place in places[i:i + TOGETHER] for x in place]
        cells += [F.lit(None).cast("int"), F.lit(None).cast("double")] * (TOGETHER - len(cells) // 2)
        parts.append(F.struct(F.lit(i).alias("_first"), *[
            x.alias(f"_{'vz'[k % 2 == 0]}{k // 2}") for k, x in enumerate(cells)]))
    together = ["_first", *[f"_{x}{k}" for k in range(TOGETHER) for x in "zv"]]
    if len(parts) == 1:
        laid = rows.select(*by, parts[0].alias("_part")).select(*by, "_part.*")
    else:
        laid = rows.select(*by, F.inline(F.array(*parts)))
    grouped = laid.groupBy(*by, *together).agg(F.count(F.lit(1)).alias("_rows"))
    cells = F.array(*[F.struct((F.col("_first") + k).alias("c"), F.col(f"_z{k}").alias("zone"),
                               F.col(f"_v{k}").alias("value")) for k in range(TOGETHER)])
    by_column = grouped.select(*by, F.inline(cells), "_rows").where(F.col("zone").isNotNull())
    return by_column.groupBy(*by, "c", "zone", "value").agg(F.sum("_rows").alias("held"))


def selected(counts: DataFrame, by: list[str], shares: Sequence[float]) -> DataFrame:
    """``*by, c`` and an array of the quantiles from the counts of the second scan."""
    spark, group = counts.sparkSession, [*by, "c"]
    path = scratch_path(spark, "counts")
    ordered = [F.col(c).asc_nulls_first() for c in [*group, "zone", "value"]]
    counts.repartitionByRange(*ordered).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(counts.withColumn("_range", F.lit(0)).schema).parquet(path)

    ranges = placed.groupBy(*group, "_range").agg(F.sum("held").alias("_sum"))
    line = Window.partitionBy(*group).orderBy("_range")
    ranges = ranges.withColumns({
        "_before": F.sum("_sum").over(line) - F.col("_sum"),
        "_n": F.sum("_sum").over(line.rowsBetween(*WHOLE))})
    # Only the ranges that a wanted rank falls into are counted value by value.
    needed = F.lit(False)
    for rank in _ranks(shares, F.col("_n")):
        needed = needed | _within(rank, F.col("_before"), F.col("_sum"))
    ranges = ranges.where(needed).alias("r")
    joined = placed.alias("p").join(ranges, same_key("p", "r", [*group, "_range"])).select(
        "p.*", "r._before", "r._n")
    inside = Window.partitionBy(*group, "_range").orderBy("zone", "value")
    start = F.col("_before") + F.sum("held").over(inside) - F.col("held")
    rows = joined.withColumn("_start", start)
    aggs = []
    for k, p in enumerate(shares):
        place = (F.col("_n") - 1) * F.lit(p)
        for name, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            missed = F.raise_error(F.lit("a quantile outside its interval: run the query again"))
            hit = F.when(_within(rank, F.col("_start"), F.col("held")),
                         F.coalesce("value", missed.cast("double")))
            aggs.append(F.max(hit).alias(f"_{name}{k}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_part{k}"))
    found = rows.groupBy(*group).agg(*aggs)
    # Between two equal values, infinite ones too, there is nothing to interpolate.
    between = [F.when(F.col(f"_low{k}") == F.col(f"_high{k}"), F.col(f"_low{k}")).otherwise(
        F.col(f"_low{k}") + F.col(f"_part{k}") * (F.col(f"_high{k}") - F.col(f"_low{k}")))
        for k in range(len(shares))]
    return found.select(*group, F.array(*between).alias("quantiles"))


def _ranks(shares: Sequence[float], n: Column) -> list[Column]:
    return [f((n - 1) * F.lit(p)) for p in shares for f in (F.floor, F.ceil)]


def _within(rank: Column, start: Column, count: Column) -> Column:
    return (rank >= start) & (rank < start + count)
