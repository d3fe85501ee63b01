"""Global ordering of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.writers import scratch_path


def sort_values(df: DataFrame, col: str = "value") -> DataFrame:
    """All rows in ascending order (strings by code point), as a range-partitioned
    sort.

    Equal values are told apart by the place of the row in the input, so that a
    value that fills much of the table is spread over several tasks.  The input
    should be a scan or a checkpointed table, whose rows have a fixed place.
    """
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    return placed.orderBy(col, "_place").drop("_place")


def rank_values(df: DataFrame, col: str = "value", partitions: int | None = None) -> DataFrame:
    """The sorted list in run-length form: each distinct value, how many ``copies``
    it has, and ``first_rank``, the 1-based place of its first copy.

    Copies are counted on the map side first.  The counts are then range-partitioned by value, into
    ``partitions`` or as many as the session shuffles into, and written; a partition is ranked on its
    own and shifted by the copies in those before it, so no task sees the whole list and the
    driver sees none of it.
    """
    spark = df.sparkSession
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("copies"))
    ranged = counts.repartitionByRange(width, F.col(col).asc_nulls_first())
    path = scratch_path(spark, "ranges")
    ranged.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(f"`{col}` {counts.schema[col].dataType.simpleString()}, copies long, _range int").parquet(path)

    sizes = placed.groupBy("_range").agg(F.sum("copies").alias("_size"))
    shift = F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")
    shifts = sizes.select("_range", shift.alias("_shift"))  # one row per partition
    inside = Window.partitionBy("_range").orderBy(F.col(col).asc_nulls_first())
    start = F.sum("copies").over(inside) - F.col("copies")
    return placed.withColumn("_start", start).join(F.broadcast(shifts), "_range").select(
        col, "copies", (F.col("_shift") + F.col("_start") + 1).alias("first_rank")
    )
