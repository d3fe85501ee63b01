"""Words one edit apart, by k-d trees over letter counts, and the commoner spelling of each.

A word is a point: how often it has each letter. One letter replaced moves the point by one down and
one up (L1 distance 2), one inserted by one up (L1 distance 1). So for each pair of lengths (l, l)
and (l, l + 1) the near words of a word lie in a small range around its point: a tree of boxes finds
the points there, and only their words are compared letter by letter.

The upper part of each length's tree is fitted to a sample and cuts the space into cells; every word
is data in its own cell, and a query in all others that its range meets. The lower part is built
over all words of a cell by the task that holds it. Which words the sample has changes how even the
cells are, never what is found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FLUSH = 250_000  # different words that a task counts before it passes them on
LEAF = 16  # points in a leaf of the lower tree
PAIRS = 1 << 22  # letter counts compared at a time

# One column of a point per letter: a-z and U+00C0 to U+00FF.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
COLUMN = np.zeros(0x100, np.int64)
COLUMN[LETTERS] = np.arange(len(LETTERS))


def damaged(doc_id: object, word: str, modulus: int) -> str:
    """``word``, without one letter if ``modulus`` divides the CRC-32 of id and word."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if modulus and h % modulus == 0:
        at = h % len(word)
        return word[:at] + word[at + 1:]
    return word


def words(docs: DataFrame, least_letters: int = 5, least: int = 3, modulus: int = 97) -> DataFrame:
    """``word, n`` of all words of ``docs`` (doc_id, text) with at least ``least_letters`` letters that
    occur at least ``least`` times. Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF;
    A-Z count as small letters, and ``damaged`` is applied (``modulus`` 0: never).

    Null text has no words, a null id counts as the empty text, rows that repeat count each. A task
    sums what it reads before the shuffle. Other columns are not read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())],
                names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), pc.cast(
                    batch.column(1), pa.large_binary())):
                small = (text.as_py() or b"").lower().decode()  # of bytes, A-Z alone
                for word, n in Counter(map(re.Match.group, RUN.finditer(small))).items():
                    word = damaged(doc_id, word, modulus)
                    if len(word) >= least_letters:
                        found[word] += n
                if len(found) >= FLUSH:
                    yield flush()
        yield flush()

    counted = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(
        count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------------------------------------
# Points and boxes


def points(some: list[str], length: int) -> np.ndarray:
    """The letter counts of words of one length."""
    codes = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(-1, length)
    at = COLUMN[codes] + np.arange(len(some))[:, None] * len(LETTERS)
    counts = np.bincount(at.ravel(), minlength=len(some) * len(LETTERS))
    return counts.reshape(len(some), -1).astype(np.int8 if length < 64 else np.int32)


def widest(some: np.ndarray) -> tuple[int, int] | None:
    """The letter by which points differ most, and the count at which to cut: up to it is left."""
    column = int(some.var(axis=0).argmax())
    values = some[:, column]
    cut = int(np.median(values))
    if cut >= values.max():
        cut = int(values.max()) - 1
    return (column, cut) if values.min() <= cut else None


@dataclass
class Cells:
    """The upper tree of one length: ``cuts[k]`` is (letter, count, left, right); negative children
    are cells, -1 - number."""

    cuts: list[tuple[int, int, int, int]]
    n: int

    def routed(self, some: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for all cells that hold points with at most ``more`` letters more and
        ``less`` letters less than the given ones."""
        at, found = np.arange(len(some)), []
        none = np.zeros(len(at), np.int64)
        # A node, the points that may still meet it, the letters more and less that its box asks
        # of them, and the box, as far as cuts above it bound the letters.
        stack = [(0 if self.cuts else -1, at, none, none, {}, {})]
        while stack:
            node, at, up, down, low, high = stack.pop()
            if not len(at):
                continue
            if node < 0:
                found.append((at, np.full(len(at), -1 - node)))
                continue
            column, cut, left, right = self.cuts[node]
            x = some[at, column].astype(np.int64)
            # Left of the cut the letter occurs at most ``cut`` times, right of it more often.
            over = down + np.maximum(x - cut, 0) - np.maximum(x - high.get(column, 1 << 40), 0)
            keep = over <= less
            stack.append((left, at[keep], up[keep], over[keep], low, high | {column: cut}))
            under = up + np.maximum(cut + 1 - x, 0) - np.maximum(low.get(column, 0) - x, 0)
            keep = under <= more
            stack.append((right, at[keep], under[keep], down[keep], low | {column: cut + 1}, high))
        rows, cells = zip(*found) if found else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        return np.concatenate(rows), np.concatenate(cells)


def cells(some: np.ndarray, wanted: int) -> Cells:
    """An upper tree with about ``wanted`` cells that hold like shares of the sample."""
    cuts: list = []
    n = 0

    def grow(some: np.ndarray, wanted: int) -> int:
        nonlocal n
        best = widest(some) if wanted > 1 and len(some) > 1 else None
        if best is None:
            n += 1
            return -n
        column, cut = best
        node = len(cuts)
        cuts.append(None)
        left = some[:, column] <= cut
        share = min(wanted - 1, max(1, round(wanted * left.mean())))
        cuts[node] = (column, cut, grow(some[left], share), grow(some[~left], wanted - share))
        return node

    grow(some, wanted)
    return Cells(cuts, n)


class Tree:
    """The lower tree over distinct points: boxes around halves of halves, down to LEAF points."""

    def __init__(self, some: np.ndarray):
        self.order = np.arange(len(some))
        self.nodes: list[tuple] = []  # low, high, left, right, begin, end
        self._grow(some, 0, len(some))
        self.points = some[self.order]

    def _grow(self, some: np.ndarray, begin: int, end: int) -> int:
        node = len(self.nodes)
        mine = some[self.order[begin:end]]
        box = mine.min(axis=0), mine.max(axis=0)
        self.nodes.append((*box, -1, -1, begin, end))
        best = widest(mine) if end - begin > LEAF else None
        if best:
            left = mine[:, best[0]] <= best[1]
            here = self.order[begin:end]
            middle = begin + int(left.sum())
            self.order[begin:end] = np.concatenate([here[left], here[~left]])
            children = self._grow(some, begin, middle), self._grow(some, middle, end)
            self.nodes[node] = (*box, *children, begin, end)
        return node

    def within(self, queries: np.ndarray, more: int, less: int) -> Iterator[tuple]:
        """(query, point) of all points that have just ``more`` letters more and ``less`` less."""
        kind = np.int32 if queries.dtype == np.int32 or self.points.dtype == np.int32 else np.int8
        queries, here = queries.astype(kind), self.points.astype(kind)
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, at = stack.pop()
            low, high, left, right, begin, end = self.nodes[node]
            q = queries[at]
            keep = ((np.maximum(low.astype(kind) - q, 0).sum(axis=1, dtype=np.int64) <= more)
                    & (np.maximum(q - high.astype(kind), 0).sum(axis=1, dtype=np.int64) <= less))
            at = at[keep]
            if not len(at):
                continue
            if left >= 0:
                stack += [(left, at), (right, at)]
                continue
            step = max(1, PAIRS // ((end - begin) * here.shape[1]))
            for i in range(0, len(at), step):
                some = at[i:i + step]
                apart = np.abs(here[None, begin:end] - queries[some][:, None]).sum(
                    axis=2, dtype=np.int64)
                row, column = np.nonzero(apart == more + less)
                if len(row):
                    yield some[row], self.order[begin + column]


# ---------------------------------------------------------------------------------------------
# Words of a cell


def replaced(a: str, b: str) -> bool:
    """True if one letter replaced turns ``a`` into ``b`` (of the same length)."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return a[i + 1:] == b[i + 1:]
    return False


def inserted(a: str, b: str) -> bool:
    """True if one letter inserted turns ``a`` into ``b`` (longer by one)."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return a[i:] == b[i + 1:]
    return True


class Best:
    """Near words so far of each word: how many, and the one to prefer."""

    def __init__(self):
        self.near: dict[str, list] = {}

    def add(self, word: str, other: str, n: int) -> None:
        mine = self.near.get(word)
        if mine is None:
            self.near[word] = [1, n, other]
        else:
            mine[0] += 1
            if n > mine[1] or (n == mine[1] and other < mine[2]):
                mine[1], mine[2] = n, other

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.near.values())) or [()] * 3
        out = pa.RecordBatch.from_arrays(
            [pa.array(self.near.keys(), pa.string()), pa.array(columns[0], pa.int64()),
             pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
            names=["word", "near", "best_n", "best"])
        self.near = {}
        return out


class Cell:
    """The words of one cell, as groups of the same letters, with the tree over their points."""

    def __init__(self, length: int, counts: dict[str, int]):
        self.length, self.counts = length, counts
        self.groups, first = self.grouped(list(counts))
        self.points = points(first, length)
        self.tree = Tree(self.points)

    @staticmethod
    def grouped(some: list[str]) -> tuple[list[list[str]], list[str]]:
        by_letters: dict[str, list[str]] = {}
        for word in some:
            by_letters.setdefault("".join(sorted(word)), []).append(word)
        groups = list(by_letters.values())
        return groups, [g[0] for g in groups]

    def found(self, queries: list[str], length: int) -> Iterator[tuple[str, str]]:
        """(query, word of the cell) of all pairs one edit apart. Queries are as long as the
        cell's words, or shorter by one."""
        groups, first = self.grouped(queries)
        mine = points(first, length)
        same = length == self.length
        for rows, places in self.tree.within(mine, 1, int(same)):
            for i, j in zip(rows.tolist(), places.tolist()):
                yield from self.edits(groups[i], mine[i], self.groups[j], self.points[j], same)

    @staticmethod
    def edits(some, a, others, b, same) -> Iterator[tuple[str, str]]:
        """The pairs one edit apart of two groups. Small groups are compared pair by pair; in
        large ones the letters to change are known, and each result is looked up."""
        if len(some) * len(others) <= 4:
            test = replaced if same else inserted
            for word in some:
                for other in others:
                    if test(word, other):
                        yield word, other
            return
        new = chr(LETTERS[int((b > a).argmax())])
        if same:
            old, those = chr(LETTERS[int((a > b).argmax())]), set(others)
            for word in some:
                for i, x in enumerate(word):
                    if x == old and (other := word[:i] + new + word[i + 1:]) in those:
                        yield word, other
        else:
            those = set(some)
            for other in others:
                for i, x in enumerate(other):
                    # Of a run of the same letter, any one taken out gives the same word.
                    if x == new and other[i - 1:i] != new:
                        if (word := other[:i] + other[i + 1:]) in those:
                            yield word, other


# ---------------------------------------------------------------------------------------------
# Spark


def fitted(vocabulary: DataFrame, cell: int, sample: int) -> dict[int, Cells]:
    """The upper tree of each length with more than ``cell`` words, from about ``sample`` words in
    all, chosen by hash. The driver gets these, and one count per length."""
    counts = {r["length"]: r["count"] for r in vocabulary.groupBy(
        F.length("word").alias("length")).count().collect()}
    large = [k for k, n in counts.items() if n > cell]
    if not large:
        return {}
    total = sum(counts[k] for k in large)
    rows = vocabulary.where(F.length("word").isin(large)).where(
        F.pmod(F.xxhash64("word"), F.lit(max(1, -(-total // sample)))) == 0).select("word").collect()
    by_length: dict[int, list[str]] = {}
    for r in rows:
        by_length.setdefault(len(r["word"]), []).append(r["word"])
    return {k: cells(points(sorted(some), k), -(-counts[k] // cell))
            for k, some in by_length.items()}


def near_words(vocabulary: DataFrame, cell: int = 8_000, sample: int = 100_000) -> DataFrame:
    """``word, near, best_n, best`` for every word of ``vocabulary`` (word, n; each word once) that has
    words one letter inserted, deleted or replaced away: how many, and of them the one with the
    largest ``n`` (of several the first by code point) with its ``n``.

    Cells hold about ``cell`` words; one that is larger, because its words share their letters or
    the sample missed them, is dealt over tasks by hash, and queries go to each part. ``sample``
    bounds the words on which the upper trees are fitted.
    """
    trees = fitted(vocabulary, cell, sample)

    def place(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.array([len(w) for w in some], np.int64)
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                mine = points([some[i] for i in at], length)
                for other in (length, length + 1) if query else (length,):
                    tree = trees.get(other, Cells([], 1))
                    if not query:
                        row, leaf = tree.routed(mine, 0, 0)
                    else:
                        row, leaf = tree.routed(mine, 1, int(other == length))
                    k = len(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, other, np.int32)), pa.array(leaf, pa.int32()),
                         batch.column(0).take(pa.array(at[row])), pa.array(n[at[row]])],
                        names=["length", "leaf", "word", "n"])

    schema = "length int, leaf int, word string, n long"
    vocabulary = vocabulary.select("word", "n")
    home = written(vocabulary.mapInArrow(lambda b: place(b, False), schema), "cells")
    # One row per cell: their number is that of the words over ``cell``.
    parts = (
        home.groupBy("length", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * cell)).cast("int")
                                           .alias("parts"))
        .select(F.col("length").alias("_length"), F.col("leaf").alias("_leaf"), "parts"))
    key = (F.col("length") == F.col("_length")) & (F.col("leaf") == F.col("_leaf"))
    data = home.join(F.broadcast(parts), key).select(
        "length", "leaf", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"),
        F.lit(False).alias("query"), "word", "n")
    # Queries to cells without words go in the join.
    asked = vocabulary.mapInArrow(lambda b: place(b, True), schema).join(F.broadcast(parts), key)
    asked = asked.select("length", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
                         .alias("part"), F.lit(True).alias("query"), "word", "n")
    stream = data.unionByName(asked).repartition("length", "leaf", "part").sortWithinPartitions(
        "length", "leaf", "part", "query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts, cell = None, {}, None
        best = Best()
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                some = batch.slice(begin, end - begin)
                if key != (key := tuple(keys[:, begin].tolist())):
                    counts, cell = {}, None
                is_query = some.column(3).to_numpy(zero_copy_only=False).astype(bool)
                word, n = some.column(4).to_pylist(), some.column(5).to_pylist()
                first = int(is_query.argmax()) if is_query.any() else len(word)
                counts.update(zip(word[:first], n[:first]))
                if first == len(word):
                    continue
                cell = cell or Cell(key[0], counts)
                asked = dict(zip(word[first:], n[first:]))
                for length in (key[0], key[0] - 1):
                    of_length = [w for w in asked if len(w) == length]
                    if not of_length:
                        continue
                    for a, b in cell.found(of_length, length):
                        best.add(a, b, counts[b])
                        if length < key[0]:
                            best.add(b, a, asked[a])
                if len(best.near) >= FLUSH:
                    yield best.batch()
        yield best.batch()

    partial = stream.mapInArrow(search, "word string, near long, best_n long, best string")
    return (
        partial.groupBy("word")
        .agg(F.sum("near").alias("near"),
             F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("_best"))
        .select("word", "near", (-F.col("_best.n")).alias("best_n"), F.col("_best.best").alias("best"))
    )


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for links (word, form) that never lead in a circle: the last word that the
    forms lead to. Every round doubles the steps; each is a written table."""
    found = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        longer = found.join(onward, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved"))
        longer = written(longer, "roots")
        if longer.where("_moved").limit(1).count() == 0:
            return longer.select("word", "root")
        found = longer.select("word", "root")


def variants(docs: DataFrame, ratio: int = 2, cell: int = 8_000, sample: int = 100_000,
             **options) -> DataFrame:
    """One row per word of ``docs`` (see ``words``): ``word, n, n_near`` (words one edit away), ``form``
    (of these the commonest, if it is at least ``ratio`` times as common, else null), ``form_n`` and
    ``root`` (where forms lead in the end; the word itself if it has none).

    An empty table, and texts without words, give no rows.
    """
    vocabulary = written(words(docs, **options), "words")
    near = near_words(vocabulary, cell, sample).withColumnRenamed("word", "_word")
    has_form = F.col("best_n") >= ratio * F.col("n")
    found = written(vocabulary.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n")), "near")
    ends = roots(found.where(F.col("form").isNotNull())).withColumnRenamed("word", "_word")
    return found.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
