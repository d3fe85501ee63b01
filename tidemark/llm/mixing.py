"""Mixing sources to target weights by a time-varying curriculum.

Every source has a target number of words. Over the training run, laid out as the time 0 to 1,
a source is read at the rate ``target * (1 + slope * (2 t - 1))``: sources with a positive slope
come late, those with a negative slope early, and the slopes are centred so that the rates of
all sources always add up to the same speed. The integral of the rate is the source's cumulative
demand; a document that lies at so many words of its source's stream is wanted at the time at
which the demand reaches it, so the inverse of the integral is its training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, boxed, fresh, same, unboxed, written

ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                   limit: float = 2.0) -> DataFrame:
    """Targets from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn, over and over. All targets
    together are ``share`` of all sizes; a target stops at ``limit`` times its source's size
    and what is over goes to the others by weight until none is above. That is: with the
    sources sorted by size over weight, a first part of them stands at its limit and the rest
    share what is left by weight; prefix sums find where the first part ends. The one-task
    windows here run over one row per source, not over documents.

    A source without words has target 0. An empty table gives no rows. If the limits together
    allow less than the share, every source stands at its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.row_number().over(by_name) - 1) % len(weights) + 1)
    every = Window.partitionBy()
    by_need = Window.orderBy((F.col("source_size") / F.col("weight")).asc(),
                             F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sizes.withColumn("weight", weight)
        .withColumn("wanted", share * F.sum("source_size").over(every))
        .withColumn("left", F.col("wanted") - limit * F.coalesce(
            F.sum("source_size").over(before), F.lit(0)))
        .withColumn("others", F.sum("weight").over(every) - F.coalesce(
            F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("left") * F.col("weight") / F.col("others")
                    >= limit * F.col("source_size"))
        # Those at their limit come first; a source after the first one below it isn't full.
        .withColumn("full", F.min("full").over(by_need.rowsBetween(*ALL_BEFORE)))
    )
    first = F.struct(F.col("full"), F.col("source_size") / F.col("weight"),
                     F.col("source").isNull(), F.col("source"), F.col("left"), F.col("others"))
    rest = F.min(F.when(~F.col("full"), first)).over(every)
    return (
        rows.withColumn("rest", rest)
        .withColumn("target", F.when(F.col("full"), limit * F.col("source_size")).otherwise(
            F.col("rest.left") * F.col("weight") / F.col("rest.others")))
        .select("source", "source_size", "weight", "target")
    )


def centred_slopes(targets: DataFrame, slopes: Sequence[float]) -> DataFrame:
    """Give the sources the slopes in turn, less their mean weighted by target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    raw = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]),
                       (F.row_number().over(by_name) - 1) % len(slopes) + 1)
    mean = F.sum(F.col("slope") * F.col("target")).over(every) / F.sum("target").over(every)
    return (
        targets.withColumn("slope", raw)
        .withColumn("slope", F.col("slope") - F.coalesce(mean, F.lit(0.0)))
    )


def scheduled(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
              limit: float = 2.0, slopes: Sequence[float] = (-0.4, 0.0, 0.4),
              buckets: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target``, the ``passes``
    that take words of the document, each with its ``epoch`` (from 1), the ``words`` it takes and
    its training ``position`` (0 to 1), ``_row``, the hash of id and text, and the row's name:
    ``source``, ``_bucket`` and its number ``_nth`` there.

    A source's documents stand in the order of md5(doc_id) in a stream that is read from its
    start, again and again, until the source's target (whole words) is reached; the document at
    the end is taken in part.

    The place in the stream is a prefix sum in two levels, first over ``buckets`` ranges of the
    hash and then inside a range, so that a source with a third of all rows is spread.

    Null text has size 0, a null id counts as the empty text, null is a source of its own. Of
    rows that repeat in id, the shorter comes first. Other columns of ``docs`` are not read.
    """
    if max(abs(s) for s in slopes) > 0.5:
        raise ValueError("slopes lie between -0.5 and 0.5, so that no rate is negative")
    rank = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    base = written(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
        .cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("_row"), rank.alias("_rank"),
    ).withColumn("_bucket", F.floor(F.conv(F.substring("_rank", 1, 6), 16, 10).cast("long")
                                    * buckets / 2 ** 24)), "mix")
    inside = Window.partitionBy("source", "_bucket").orderBy("_rank", "doc_id", "size", "_row")
    offsets = (
        base.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
        .withColumn("_start", F.sum("_size").over(
            Window.partitionBy("source").orderBy("_bucket").rowsBetween(*ALL_BEFORE))
            - F.col("_size"))
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_start")
    )
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = centred_slopes(source_targets(sizes, weights, share, limit), slopes).select(
        F.col("source").alias("_t"), "source_size", "target", "slope")
    offsets = offsets.join(targets, same(F.col("_s"), F.col("_t"))).drop("_t")
    placed = base.join(
        offsets, same(F.col("source"), F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    at = F.col("_start") + F.sum("size").over(inside.rowsBetween(*ALL_BEFORE)) - F.col("size")
    words = F.floor(F.col("target"))

    def took(skip):
        """Words of the document in the pass that starts after ``skip`` words."""
        return F.greatest(F.lit(0), F.least(F.col("size"), words - skip - F.col("_at")))

    def position(skip):
        """The time at which the cumulative demand reaches the document:
        t + slope (t*t - t) = demand / target, solved for t."""
        part = (F.col("_at") + skip) / F.col("target")
        b = 1 - F.col("slope")
        root = F.sqrt(b * b + 4 * F.col("slope") * part)
        return 2 * part / (b + root)

    skips = [F.col("source_size") * k for k in range(int(-(-limit // 1)))]
    every = F.array(*[F.struct(F.lit(k + 1).alias("epoch"), took(p).cast("long").alias("words"),
                               F.when(took(p) > 0, position(p)).alias("position"))
                      for k, p in enumerate(skips)])
    return (
        placed.withColumn("_at", at).withColumn("_nth", F.row_number().over(inside))
        .withColumn("passes", F.filter(every, lambda p: p["words"] > 0))
        .select("doc_id", "source", "size", "source_size", "target", "passes", "_row", "_bucket",
                "_nth")
    )


def ordered(docs: DataFrame, **options) -> DataFrame:
    """The mix of ``docs`` in training order, without their texts: one row per pass in which a
    document is taken, with the columns of ``scheduled`` and ``epoch``, ``words`` and
    ``position``, range-sorted by position and written. Documents of which nothing is taken stand
    behind the others, with nulls.
    """
    by = F.col("position").asc_nulls_last(), F.col("_bucket"), F.col("_nth")
    laid = scheduled(docs, **options).withColumn("_pass", F.explode_outer("passes"))
    return written(
        laid.select(*[c for c in laid.columns if c not in ("passes", "_pass")], "_pass.*")
        .repartitionByRange(*by).sortWithinPartitions(*by), "order")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken``, the
    training positions ``first_position`` and ``second_position`` (0 to 1; null where the pass
    is not taken) and ``_row``, the hash of id and text. ``options`` are those of ``scheduled``.

    The rows are read off the training order: ``taken`` counts the words that its passes take.
    """
    def of_pass(epoch):
        return F.max(F.when(F.col("epoch") == epoch, F.col("position")))

    return (
        ordered(docs, **options)
        .groupBy("source", "_bucket", "_nth", "doc_id", "size", "source_size", "target", "_row")
        .agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"),
             of_pass(1).alias("first_position"), of_pass(2).alias("second_position"))
        .select("doc_id", "source", "size", "source_size", "target", "taken",
                "first_position", "second_position", "_row")
    )


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` in training order: every column of ``docs``, with ``position``
    and ``epoch`` (from 1), one row per pass in which the document is taken, range-sorted by
    position. Documents of which nothing is taken are left out.

    Rows that repeat get a place each: equal rows are numbered on both sides, and the numbers
    meet beside the hash, so that one shuffle of the documents serves numbering and join.
    """
    position, epoch = fresh(docs, "position", "epoch")
    placed = scheduled(docs, **options).select(
        F.col("_row").alias("_hash"), F.col("passes").alias("_passes"),
        F.row_number().over(Window.partitionBy("_row").orderBy("doc_id", "size"))
        .alias("_number"))
    keyed = boxed(docs, "doc_id").withColumn("_key", F.xxhash64(
        F.col("_row").getField("doc_id"), F.col("_row").getField("text")))
    keyed = keyed.withColumn("_nth", F.row_number().over(
        Window.partitionBy("_key").orderBy("doc_id")))
    # Written as a difference, the number is no join key, and the hash alone deals the rows.
    joined = keyed.join(placed, (F.col("_key") == F.col("_hash"))
                        & (F.col("_nth") - F.col("_number") == 0))
    return (
        joined.select("_row", F.explode("_passes").alias("_pass"))
        .select(*unboxed(docs.columns), F.col("_pass.position").alias(position),
                F.col("_pass.epoch").alias(epoch))
        .repartitionByRange(position).sortWithinPartitions(position)
    )
