import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_rows import ODD, rows
from pyspark.sql import functions as F

from tidemark.llm import spelling
from tidemark.llm.queries import SPELLINGS_SQL

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(table):
    counts = Counter()
    for doc_id, text in table:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, near = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if abs(len(x) - len(w)) <= 1 and one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, near[w], counts.get(forms[w])))
    return sorted(out, key=repr)


def variants(df, **options):
    return rows(spelling.variants(df, **options).select(*COLUMNS))


def misspelt(seed, n=150, docs=90):
    """Texts of a few words and of random edits of them, some words with the same letters."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    base += ["".join(rng.sample("abcde", 5)) for _ in range(80)] + ["aaaaa", "aaaaaa", "aaaaab", "aaaaaaa"]
    table = []
    for doc_id in range(docs):
        some = []
        for _ in range(200):
            w = rng.choice(base[:1 + int(rng.random() ** 2 * len(base))])
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abÉ") + w[i:],
                                w[:i] + rng.choice("abc") + w[i + 1:]])
            some.append(w.title() if rng.random() < 0.2 else w)
        table.append((doc_id if doc_id % 10 else None, rng.choice([" ", ", ", "1"]).join(some)))
    return table


@pytest.mark.parametrize("cell, sample", [(8000, 100_000), (40, 500), (5, 60), (3, 1)])
def test_variants(spark, cell, sample):
    table = misspelt(cell)
    df = spark.createDataFrame(table, "doc_id long, text string")
    found = variants(df, cell=cell, sample=sample)
    assert found == brute(table)
    assert any(r[1] for r in found) and any(r[1] and r[1] != r[2] for r in found)


def test_sql_on_the_same_rows(spark):
    table = misspelt(9)
    documents = spark.createDataFrame(table, "doc_id long, text string").toPandas().astype(
        {"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    found = con.execute(f"SELECT {','.join(COLUMNS)} FROM ({SPELLINGS_SQL})").fetchall()
    assert sorted(found, key=repr) == brute(table)


def test_whole_table(spark, docs):
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.execute(f"SELECT {','.join(COLUMNS)} FROM ({SPELLINGS_SQL})").fetchall()
    assert variants(docs) == variants(docs, cell=100, sample=2000) == sorted(want, key=repr)
    assert len(table) > 100 and len(want) > 100


def test_odd_rows(spark, odd, clashing, nothing):
    want = brute([r[:2] for r in ODD])
    assert variants(odd) == variants(clashing) == want and want
    assert variants(nothing) == []
    none = spark.createDataFrame([(1, "1 2 3"), (2, None)], "doc_id long, text string")
    assert variants(none) == []


def test_columns_that_clash(spark, odd):
    more = odd.withColumns({c: F.lit("kept") for c in "word n near leaf part query root form".split()})
    assert variants(more) == brute([r[:2] for r in ODD])


def test_very_long_words(spark):
    a, b = "ab" * 20_000, "ab" * 9_000 + "xab" + "ab" * 11_000
    table = [(i, " ".join([a] * 4 + [b])) for i in range(3)]
    assert variants(spark.createDataFrame(table, "doc_id long, text string")) == brute(table)


def test_routes_lead_to_every_near_point():
    rng = np.random.default_rng(1)
    some = rng.poisson(0.4, (3000, len(spelling.LETTERS))).astype(np.int8)
    tree = spelling.cells(some[:500], 40)
    home = np.empty(len(some), np.int64)
    at, cell = tree.routed(some, 0, 0)
    assert sorted(at.tolist()) == list(range(len(some)))
    home[at] = cell
    assert len(set(home.tolist())) > 25
    queries = some[rng.permutation(len(some))[:400]].copy()
    rows_, cells_ = tree.routed(queries, 1, 1)
    routes = set(zip(rows_.tolist(), cells_.tolist()))
    diff = some[None].astype(np.int16) - queries[:, None]
    for q, x in zip(*np.nonzero((np.maximum(diff, 0).sum(2) <= 1) & (np.maximum(-diff, 0).sum(2) <= 1))):
        assert (q, home[x]) in routes
    assert len(routes) < 0.8 * 400 * tree.n
