"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Every 5 consecutive words have a hash, and of every 6 consecutive hashes the smallest is a
fingerprint. Ten equal words in a row therefore have the same fingerprint in a document and in a
benchmark item, whatever stands around them: no shared window of ten words is missed. Documents
that share a fingerprint with the benchmark are read again; each of their windows whose fingerprint
was met is compared with the windows of the items word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, is_small, let, lower_ascii, unboxed, written

WINDOW = 10
GRAM = 5


def words_of(text: Column) -> Column:
    """The runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case; no words
    for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(parts, "")


def steps(count: Column) -> Column:
    """0 to count - 1 as an array; empty where count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>"))


def prints_of(words: Column, window: int, gram: int) -> Column:
    """The fingerprint of each window of words, in order."""
    wide = window - gram + 1

    def smallest(hashes: Column) -> Column:
        at = lambda i: [F.get(hashes, i + j) for j in range(wide)]
        return F.transform(steps(F.size(hashes) - wide + 1),
                           lambda i: F.least(*at(i)) if wide > 1 else at(i)[0])

    hashes = F.transform(steps(F.size(words) - gram + 1), lambda i: F.xxhash64(
        *[F.get(words, i + j) for j in range(gram)]))
    return let(hashes, smallest)


def windows_of(words: Column, length: int) -> Column:
    """(start, words joined by spaces) of each run of ``length`` words."""
    return F.transform(steps(F.size(words) - length + 1), lambda i: F.struct(
        i.alias("start"), F.array_join(F.slice(words, i + 1, length), " ").alias("words")))


def sent(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its measured size allows; joins shuffle otherwise."""
    return F.broadcast(df) if is_small(df) else df


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, row_hash (of id and text), n_words,
    n_hit (words inside an occurrence of a window), items (the ids of the items with occurring
    windows, sorted as strings).

    A window is ``window`` consecutive words of an item (item_id, text); an item with fewer
    words, but not none, is one window, and is looked up at every place, without fingerprints.
    Null texts have no words, null item ids count as items but are not listed. Repeated rows get
    equal rows; without documents or items there are no hits.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    bench = written(items.select(F.col("item_id").cast("string").alias("item"),
                                 words_of(F.col("text")).alias("words"))
                    .where(F.size("words") > 0), "items")
    whole = bench.where(F.size("words") >= window)
    item_windows = sent(written(
        whole.select("item", F.explode(windows_of(F.col("words"), window)).alias("w"))
        .select("item", F.col("w.words").alias("window")).distinct(), "windows"))
    item_prints = sent(written(
        whole.select(F.explode(prints_of(F.col("words"), window, gram)).alias("print"))
        .distinct(), "prints"))
    read = written(
        docs.select("doc_id", "row_hash", let(words_of(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.array_distinct(prints_of(w, window, gram)).alias("prints"))).alias("r"))
        .select("doc_id", "row_hash", "r.n_words", "r.prints"), "read")
    met = written(
        read.select("row_hash", F.explode("prints").alias("print")).join(item_prints, "print")
        .groupBy("row_hash").agg(F.collect_set("print").alias("met")), "met")
    again = docs.join(met.withColumnRenamed("row_hash", "_key"), F.col("row_hash") == F.col("_key"))
    hit = let(words_of(F.col("text")), lambda w: let(
        F.arrays_zip(prints_of(w, window, gram).alias("print"), windows_of(w, window).alias("w")),
        lambda z: F.transform(F.filter(z, lambda x: F.array_contains(F.col("met"), x["print"])),
                              lambda x: x["w"])))
    found = (
        again.select("row_hash", F.explode(hit).alias("w"))
        .select("row_hash", F.col("w.start").alias("start"), F.col("w.words").alias("window"))
        .join(item_windows, "window")
        .select("row_hash", "start", F.lit(window).alias("length"), "item")
    )
    few = bench.where(F.size("words") < window).select(
        "item", F.size("words").alias("length"), F.array_join("words", " ").alias("window"))
    # At most window - 1 different lengths.
    for (length,) in few.select("length").distinct().collect():
        short = sent(written(few.where(F.col("length") == length).select("item", "window")
                             .distinct(), "short"))
        every = let(words_of(F.col("text")), lambda w: windows_of(w, length))
        found = found.union(
            docs.select("row_hash", F.explode(every).alias("w"))
            .select("row_hash", F.col("w.start").alias("start"), F.col("w.words").alias("window"))
            .join(short, "window")
            .select("row_hash", "start", F.lit(length).alias("length"), "item"))
    # First by place, so that a window of many items is one place, then by document.
    spots = found.groupBy("row_hash", "start", "length").agg(F.collect_set("item").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform(
        F.collect_list(F.struct("start", "length")),
        lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    hits = spots.groupBy(F.col("row_hash").alias("_key")).agg(
        F.size(covered).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<string>")
    return (
        read.drop("prints").join(hits, F.col("row_hash") == F.col("_key"), "left")
        .select("doc_id", "row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                F.coalesce("items", none).alias("items"))
    )


def without_overlap(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                    gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    hit = overlaps(docs, items, window, gram).where("n_hit > 0").select(
        F.col("row_hash").alias("_hit")).distinct()
    keyed = boxed(docs, "doc_id", "text").select(
        "_row", F.xxhash64("doc_id", "text").alias("_key"))
    clean = keyed.join(hit, F.col("_key") == F.col("_hit"), "left_anti")
    return clean.select(*unboxed(docs.columns))
