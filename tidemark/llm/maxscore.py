"""Exact top-k search by inner product with MaxScore.

A query's terms are its non-zero dimensions. A posting list of a term holds the vectors with a
positive or with a negative value there; a query reads the list whose values agree in sign with
its own, where the product adds to the score. The largest product of a list bounds what a term
can add. Terms whose bounds together stay below the k-th best score so far are non-essential: a
vector that is in none of the other (essential) lists cannot enter the result. Essential lists
are traversed, the other terms are probed one by one, the strongest first, for the vectors that
can still compete. Every shard keeps its k best, and the shards' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_width, written

PACK = "part int, n int, width int, ids binary, values binary"


def scaled(vectors: DataFrame, factor: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(factor * x) of each component. Rows with a null id, a null vector or
    a null or non-finite component take no part. Of rows that repeat an id with different
    vectors, the smallest vector counts."""
    x = F.col("embedding")
    # NaN and infinities are not within the doubles' range: both comparisons fail.
    finite = F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) <= 1.7976931348623157e308))
    return (
        vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
        .select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * factor)
                                      .cast("long")).alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def packed(rows: DataFrame, block: int) -> DataFrame:
    """The vectors of each partition in blocks of at most ``block`` rows, one binary row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, vectors = TaskContext.get().partitionId(), [], []

        def out() -> pa.RecordBatch:
            width = max(map(len, vectors))
            table = np.zeros((len(vectors), width), np.int64)
            for row, v in zip(table, vectors):
                row[:len(v)] = v
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
                 "width": pa.array([width], pa.int32()),
                 "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 "values": pa.array([table.tobytes()], pa.binary())})

        for batch in batches:
            flat, column = batch.column(0).to_numpy(), batch.column(1)
            for vec_id, v in zip(flat.tolist(), column):
                ids.append(vec_id)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == block:
                    yield out()
                    ids, vectors = [], []
        if ids:
            yield out()

    return rows.select("vec_id", "v").mapInArrow(pack, PACK)


def unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    return ids, np.frombuffer(row[f"{side}_values"], np.int64).reshape(
        row[f"{side}_n"], row[f"{side}_width"])


def shard_top(query_id: int, query: np.ndarray, ids: np.ndarray, columns: np.ndarray,
              lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of the k best vectors of a shard, ties to the smaller id. ``columns``
    holds the shard by dimension, ``lows`` and ``highs`` the extremes of each dimension."""
    width = min(len(query), len(columns))
    terms = np.flatnonzero(query[:width])
    weights = query[terms]
    # What a term adds at most: the best product of the list that agrees in sign, or nothing.
    bounds = np.maximum(np.where(weights > 0, weights * highs[terms], weights * lows[terms]), 0)
    order = np.argsort(-bounds, kind="stable")
    terms, weights, bounds = terms[order], weights[order], bounds[order]
    rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])  # of the terms from here on
    usable = ids != query_id
    if not usable.any():
        return ids[:0], ids[:0]
    floor = None  # the k-th best score so far
    if len(terms) and usable.sum() > k:
        # First scores: the vectors with the largest products in the strongest list.
        first = columns[terms[0]] * weights[0]
        first = np.where(usable, first, np.iinfo(np.int64).min)
        probe = np.argpartition(-first, min(4 * k, len(first) - 1))[:4 * k]
        probe = probe[usable[probe]]
        if len(probe) >= k:
            scores = weights @ columns[np.ix_(terms, probe)]
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    if floor is not None and floor > 0:
        essential = max(1, int(np.searchsorted(-rest, -floor, side="right")))
        # A vector outside all essential lists stays below the k-th best score. Adding up the
        # lists from the strongest on, it is dropped when it cannot reach that score any more.
        found = np.zeros(len(ids), bool)
        for t, w in zip(terms[:essential], weights[:essential]):
            found |= columns[t] * np.sign(w) > 0
        rows = np.flatnonzero(found & usable)
    else:
        rows = np.flatnonzero(usable)
    sums = np.zeros(len(rows), np.int64)
    for i, (t, w) in enumerate(zip(terms, weights)):
        sums += columns[t][rows] * w
        if floor is not None and i + 1 < len(terms):
            keep = sums + rest[i + 1] >= floor
            if not keep.all():
                rows, sums = rows[keep], sums[keep]
    best = np.lexsort((ids[rows], -sums))[:k]
    return ids[rows[best]], sums[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = 4096,
           block: int = 512) -> DataFrame:
    """For each row of ``queries`` its ``k`` best rows of ``vectors`` (both as ``scaled`` gives
    them): query_id, rank (from 1), vec_id, score. A query never finds its own id; ties go to
    the smaller vec_id; a query with fewer candidates gets all of them. Vectors of different
    lengths are compared over the dimensions that both have. No queries or no vectors: no rows.

    Vectors are packed in shards of at most ``shard`` rows and queries in blocks of at most
    ``block``; each block meets each shard, one pair at a time in a task.
    """
    total = vectors.count()
    parts = max(shuffle_width(vectors), -(-total // shard))
    shards = written(packed(vectors.repartition(parts, "vec_id"), shard), "shards")
    blocks = written(packed(queries.repartition(max(1, -(-queries.count() // block)), "vec_id"),
                            block), "blocks")
    numbers = shards.select("part").distinct()
    # Equal keys deal the pairs over tasks: each shard's number once for each block.
    left = shards.select(F.col("part").alias("shard"), *[F.col(c).alias(f"s_{c}") for c in
                                                         ("n", "width", "ids", "values")])
    top = numbers.agg(F.max("part")).first()[0]
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(top or 0)))).select(
        "shard", *[F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "values")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, values = unpack(row, "s")
                query_ids, queries = unpack(row, "q")
                columns = np.ascontiguousarray(values.T)
                lows, highs = columns.min(axis=1), columns.max(axis=1)
                found = [shard_top(q, v, ids, columns, lows, highs, k)
                         for q, v in zip(query_ids.tolist(), queries)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(query_ids, [len(f[0]) for f in found]),
                    "vec_id": np.concatenate([f[0] for f in found]),
                    "score": np.concatenate([f[1] for f in found])})

    pairs = left.join(right, "shard").drop("shard")
    best = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
