"""Gradient boosting over few-valued features, as sums by groups and column expressions.

Rows with equal features are alike to a tree, so the data enters as one count of positives and
negatives per combination of features: a sum over all rows in Spark whose result is bounded by the
number of combinations. Trees of depth two are fitted to these counts and applied as columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Feature and value asked at the root, then (feature, value, yes, no) on either side."""
    root: tuple[int, int]
    yes: tuple[int, int, float, float]
    no: tuple[int, int, float, float]

    def __call__(self, row: Sequence[int]) -> float:
        f, v, yes, no = self.yes if row[self.root[0]] <= self.root[1] else self.no
        return yes if row[f] <= v else no

    def column(self, features: Sequence[Column]) -> Column:
        def side(s: tuple[int, int, float, float]) -> Column:
            return F.when(features[s[0]] <= s[1], s[2]).otherwise(s[3])

        return F.when(features[self.root[0]] <= self.root[1], side(self.yes)).otherwise(side(self.no))


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Tree, ...]

    def __call__(self, row: Sequence[int]) -> float:
        return self.start + sum(t(row) for t in self.trees)

    def column(self, features: Sequence[Column]) -> Column:
        return sum((t.column(features) for t in self.trees), F.lit(self.start))


def fit(counts: Sequence[tuple[Sequence[int], int, int]], rounds: int = 30, rate: float = 0.3,
        damping: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss on (features, positives, negatives)."""
    total = sum(p + n for _, p, n in counts)
    positive = sum(p for _, p, _ in counts)
    start = math.log((positive + 1) / (total - positive + 1))
    cuts = sorted({(f, v) for row, _, _ in counts for f, v in enumerate(row)})
    scores = [start] * len(counts)
    trees: list[Tree] = []

    def gain(g: float, h: float) -> float:
        return g * g / (h + damping)

    def best(rows: list[int], slopes: list[tuple[float, float]]) -> tuple[float, tuple[int, int]]:
        g, h = (sum(slopes[i][k] for i in rows) for k in (0, 1))
        found = (gain(g, h), cuts[0])
        for f, v in cuts:
            yes = [i for i in rows if counts[i][0][f] <= v]
            gy, hy = (sum(slopes[i][k] for i in yes) for k in (0, 1))
            value = gain(gy, hy) + gain(g - gy, h - hy)
            if value > found[0] + 1e-12:
                found = (value, (f, v))
        return found

    for _ in range(rounds if counts else 0):
        slopes = []
        for (_, p, n), s in zip(counts, scores):
            q = 1 / (1 + math.exp(-s))
            slopes.append((p - (p + n) * q, (p + n) * q * (1 - q)))
        root = best(list(range(len(counts))), slopes)[1]
        sides = []
        for wanted in (True, False):
            rows = [i for i, c in enumerate(counts) if (c[0][root[0]] <= root[1]) == wanted]
            f, v = best(rows, slopes)[1] if rows else root
            leaf = []
            for side in (True, False):
                part = [i for i in rows if (counts[i][0][f] <= v) == side]
                leaf.append(rate * sum(slopes[i][0] for i in part)
                            / (sum(slopes[i][1] for i in part) + damping))
            sides.append((f, v, *leaf))
        tree = Tree(root, *sides)
        trees.append(tree)
        scores = [s + tree(c[0]) for s, c in zip(scores, counts)]
    return Boosted(start, tuple(trees))


def calibrated(model: Boosted, counts: Sequence[tuple[Sequence[int], int, int]],
               precision: float) -> float:
    """The lowest score from which on, upwards, the counts that the model has not seen keep the
    precision at each score; infinite if none does."""
    ranked = sorted(((model(row), p, n) for row, p, n in counts), reverse=True)
    limit, right, wrong = math.inf, 0, 0
    for i, (score, p, n) in enumerate(ranked):
        right, wrong = right + p, wrong + n
        if i + 1 < len(ranked) and ranked[i + 1][0] == score:
            continue
        # One more on either side: few cases prove little.
        if (right + 1) / (right + wrong + 2) < precision:
            break
        limit = score
    return limit
