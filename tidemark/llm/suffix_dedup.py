"""Repeated substrings, by prefix doubling over the positions of all texts.

Prefix doubling names the strings at all positions by rank: the name of the 2h bytes at a position
is the pair of the names of the h bytes there and h bytes on, and equal pairs get equal names. A
position whose name is unique is done. Here the first doublings (up to 24 bytes) are named by hashes
inside the tasks that read the texts. Of the 27 names of 24 bytes in each string of 50 bytes, the
smallest is the string's anchor; equal strings have it at the same place, so that only anchors
need be sorted, one position in fourteen. Spark then sorts, at growing offsets:

1. the pair of an anchor's 24 bytes and its block, the bytes of all 50-byte strings that
   have it as their anchor. A block that a smaller document has as well is removed whole, and
   an anchor that no other document has is done;
2. of the blocks that differ though their anchors agree, each 50-byte string.

Between the steps the rows are written to the shared folder. A task first settles what repeats
within its own batch of documents, so that copies of one passage do not meet in one place.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, shuffle_width, texts, written

GRAM = 24
# Texts are read in parts of this many strings; places inside a part fit in the low bits.
PLACE_BITS = 18
PART = (1 << PLACE_BITS) - 1024
_LOW = np.uint64((1 << PLACE_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15


def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, the powers of the base, and their inverses, modulo 2 ** 64."""
    values = np.random.default_rng(50).integers(0, 2 ** 64, 256, dtype=np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    powers, inverses = np.empty(size, np.uint64), np.empty(size, np.uint64)
    powers[0] = inverses[0] = 1
    powers[1:], inverses[1:] = np.uint64(_BASE), np.uint64(inverse)
    return values, np.cumprod(powers), np.cumprod(inverses)


_VALUES, _POWERS, _INVERSES = _tables((1 << PLACE_BITS) + 1024)


def prefix_sums(part: np.ndarray) -> np.ndarray:
    """Sums from which the hash of every substring follows."""
    found = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_VALUES[part] * _POWERS[:len(part)], out=found[1:])
    return found


def hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of the substrings from start to stop."""
    return mix64((sums[stop] - sums[start]) * _INVERSES[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        rest = width - size
        values = np.minimum(values[:-rest], values[rest:])
    return values


def parts(text: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of parts that start ``PART`` apart and hold the strings that start there."""
    for offset in range(0, max(0, len(text) - length + 1), PART):
        yield offset, text[offset:offset + PART + length - 1]


def blocks(text: bytes, length: int) -> list[np.ndarray]:
    """Of each block: the hash of its anchor's bytes and of its own, and the starts of its first
    and of its last string."""
    out = []
    for offset, part in parts(np.frombuffer(text, np.uint8), length):
        sums = prefix_sums(part)
        count = len(part) - GRAM + 1
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * _INVERSES[:count])
        places = np.arange(count, dtype=np.uint64)
        # Of equal hashes the first: the places in the low bits decide.
        least = sliding_min((grams & ~_LOW) | places, length - GRAM + 1) & _LOW
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        last = np.concatenate([first[1:], [len(least)]]) - 1
        out.append((grams[least[first].astype(np.int64)], hashes(sums, first, last + length),
                    first + offset, last + offset))
    return [np.concatenate(c) for c in zip(*out)] if out else []


def strings(text: bytes, length: int, first: np.ndarray, last: np.ndarray) -> tuple:
    """The hash and the start of each string that starts from a ``first`` to its ``last``."""
    names, starts = [], []
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    for offset, part in parts(np.frombuffer(text, np.uint8), length):
        low, high = np.searchsorted(first, [offset, offset + PART])
        if low == high:
            continue
        sums = prefix_sums(part)
        counts = last[low:high] - first[low:high] + 1
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(first[low:high] - offset - ends + counts, counts)
        names.append(hashes(sums, at, at + length))
        starts.append(at + offset)
    return (np.concatenate(names), np.concatenate(starts)) if names else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64))


def settled(names: np.ndarray, order: np.ndarray) -> np.ndarray:
    """True for rows whose name a smaller document of the batch has too."""
    if not len(names):
        return np.zeros(0, bool)
    by_name = np.argsort(names, kind="stable")
    new = np.concatenate([[True], names[by_name][1:] != names[by_name][:-1]])
    least = np.minimum.reduceat(order[by_name], np.flatnonzero(new))
    found = np.empty(len(names), bool)
    found[by_name] = order[by_name] > least[np.cumsum(new) - 1]
    return found


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs that are done and whose results are written;
    otherwise they stay until the driver happens to collect its garbage. What a job's listeners
    still hold at first goes the second time."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


# The low bits of a block's key, below its gram: whether it is settled, and how many strings
# follow its first. Few bytes count here, for there is a row for every anchor.
SURE_BIT, COUNT_BITS = 23, 8
KEY_BITS = 24
BLOCKS = "key long, name long, ord long, row_hash long, first int"


def all_blocks(docs: DataFrame, length: int) -> DataFrame:
    """The blocks of all texts. ``sure`` rows have a copy in a smaller document of their batch;
    they are dealt at random instead of by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [blocks(t or b"", length) for t in texts(batch.column(2))]
            sizes = [len(f[0]) if f else 0 for f in found]
            if not sum(sizes):
                continue
            gram, name, first, last = (np.concatenate([f[i] for f in found if f]) for i in range(4))
            order, keys = np.repeat(order, sizes), np.repeat(keys, sizes)
            sure = settled(name, order)
            spread = mix64(keys.view(np.uint64) + first.astype(np.uint64))
            key = np.where(sure, spread, gram) >> np.uint64(KEY_BITS) << np.uint64(KEY_BITS)
            key |= sure.astype(np.uint64) << np.uint64(SURE_BIT)
            key |= (last - first).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [signed(key), signed(name), pa.array(order), pa.array(keys),
                 pa.array(first.astype(np.int32))],
                names=["key", "name", "ord", "row_hash", "first"])

    return docs.select("ord", "row_hash", "text").mapInArrow(run, BLOCKS)


def all_strings(docs: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """Each string in the ``ranges`` (row_hash, first, last) of the texts."""
    lists = ranges.groupBy(F.col("row_hash").alias("_key")).agg(
        F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = docs.join(lists, F.col("row_hash") == F.col("_key")).select(
        "ord", "row_hash", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            names, starts = [], []
            for text, (first, last) in zip(texts(batch.column(2)), bounds(batch.column(3))):
                n, s = strings(text or b"", length, first, last)
                names.append(n)
                starts.append(s)
            sizes = [len(n) for n in names]
            if not sum(sizes):
                continue
            name, first = np.concatenate(names), np.concatenate(starts)
            order, keys = np.repeat(order, sizes), np.repeat(keys, sizes)
            sure = settled(name, order)
            spread = mix64(keys.view(np.uint64) + first.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [signed(np.where(sure, spread, name)), pa.array(order), pa.array(keys),
                 pa.array(first.astype(np.int32)), pa.array(sure)],
                names=["name", "ord", "row_hash", "first", "sure"])

    return joined.mapInArrow(run, "name long, ord long, row_hash long, first int, sure boolean")


def bounds(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two fields of each list of pairs; none for null."""
    offsets = column.offsets.to_numpy()
    low, high = (column.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64)
                 for i in (0, 1))
    for k in range(len(column)):
        part = slice(offsets[k], offsets[k + 1] if column[k].is_valid else offsets[k])
        yield low[part], high[part]


def merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """The union of the spans [low, high) as spans that do not touch."""
    if not len(low):
        return []
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(low) - 1]])
    return list(zip(low[new].tolist(), high[ends].tolist()))


def repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(row_hash, spans): of each text, the pieces covered by a string of ``length`` bytes that
    also starts in a document with a smaller doc_id, as spans (low, high) that may overlap.

    ``docs`` is (doc_id, text). Matches do not cross documents. A null text is empty; a null id
    comes after all others and is smaller than none; rows that repeat an id do not count as
    smaller than each other; equal rows have one entry.
    """
    if not 2 * GRAM <= length < GRAM + (1 << COUNT_BITS):
        raise ValueError(f"strings have {2 * GRAM} to {GRAM + (1 << COUNT_BITS) - 1} bytes")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1)).alias("ord"),
                       F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    gram = F.shiftright("key", KEY_BITS)
    # Both windows share one sort.
    same_block = Window.partitionBy("gram", "name")
    same_gram = Window.partitionBy("gram").orderBy("name").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        all_blocks(docs, length).repartition(shuffle_width(docs), gram.alias("gram"))
        .withColumn("gram", gram)
        .withColumn("least", F.min("ord").over(same_block))
        .withColumn("open", (F.min("name").over(same_gram) != F.max("name").over(same_gram))
                    & (F.min("ord").over(same_gram) != F.max("ord").over(same_gram)))
        .withColumn("gone", (F.getbit("key", F.lit(SURE_BIT)) == 1) | (F.col("ord") > F.col("least")))
        .where("gone or open")
        .select("row_hash", "first", (F.col("first") + F.col("key").bitwiseAND(
            F.lit((1 << COUNT_BITS) - 1))).cast("int").alias("last"), "gone")
    )
    ranked = written(ranked, "blocks")
    release(spark)
    each = all_strings(docs, ranked.where("not gone").drop("gone").distinct(), length)
    least = F.min("ord").over(Window.partitionBy("name"))
    each = (
        each.withColumn("least", least).where(F.col("sure") | (F.col("ord") > F.col("least")))
        .select("row_hash", F.col("first").alias("low"), (F.col("first") + length).alias("high"))
    )
    each = written(each, "strings")
    release(spark)
    whole = ranked.where("gone").select(
        "row_hash", F.col("first").alias("low"), (F.col("last") + length).alias("high"))
    return whole.union(each).distinct().groupBy("row_hash").agg(
        F.collect_list(F.struct("low", "high")).alias("spans"))


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    ``kept``, the remaining bytes of the text as binary."""
    spans = repeats(docs, length).withColumnRenamed("row_hash", "_key")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.xxhash64("doc_id", "text").alias("row_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, (low, high) in zip(texts(batch.column(1)), bounds(batch.column(2))):
                text, gone = text or b"", merged(low, high)
                cuts = [0, *[p for s in gone for p in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                rows.append((len(text), len(text) - len(kept), len(gone), kept))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]],
                 pa.array(columns[3], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed.join(spans, F.col("row_hash") == F.col("_key"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
