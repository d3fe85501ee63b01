import math
import random

import duckdb
import numpy as np
import pytest
from llm_brute import WORD
from llm_rows import ODD, SF_DIR, rows
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import maxscore, mixing
from tidemark.llm.common import written
from tidemark.llm.queries import ORACLE, QUERIES

TABLES = "documents embeddings pages benchmark conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = rows(found.select(*columns))
    want = con.execute(f"SELECT {','.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == sorted(want, key=repr)


def best(vectors, k):
    out = []
    for q, v in vectors.items():
        if q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, block", [(7, 3), (2048, 256)])
def test_search_with_ties_negatives_and_odd_vectors(spark, shard, block):
    rng = random.Random(1)
    vectors = {i: [rng.choice([-0.5, 0.0, 0.0, 0.25, 1.5]) for _ in range(6)] for i in range(160)}
    vectors |= {i: [-1.0] * 6 for i in range(160, 170)}  # nothing scores well with these
    vectors |= {200: [0.0] * 6, 250: [-0.1, 0.004], 300: []}
    odd = [(1001, None), (None, [1.0] * 6), (1002, [1.0, None]), (1003, [math.nan]), (1004, [math.inf])]
    table = spark.createDataFrame([*vectors.items(), *odd, (3, vectors[3])],
                                  "vec_id long, embedding array<float>")
    scaled = maxscore.scaled(table)
    got = rows(maxscore.search(scaled, scaled.where("vec_id % 50 = 0"), 5, shard, block))
    assert got == best({i: [math.floor(256 * np.float32(x)) for x in v] for i, v in vectors.items()}, 5)


def test_search_skips_what_cannot_compete():
    """The shard search agrees with brute force on vectors of very different lengths."""
    rng = np.random.default_rng(2)
    table = (rng.standard_normal((500, 16)) * rng.exponential(40, (500, 1))).astype(np.int64)
    ids = rng.permutation(5000)[:500]
    columns = np.ascontiguousarray(table.T)
    for q in range(40):
        found = maxscore.shard_top(int(ids[q]), table[q], ids, columns, columns.min(axis=1),
                                   columns.max(axis=1), 5)
        scores = table @ table[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        assert found[0].tolist() == ids[order].tolist()
        assert found[1].tolist() == scores[order].tolist()


def test_search_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.search(maxscore.scaled(table), maxscore.scaled(table)).count() == 0
    one = maxscore.scaled(spark.createDataFrame([(50, [1.0])], table.schema))
    assert maxscore.search(one, one).count() == 0


def test_mix_of_odd_rows(odd):
    found = mixing.mix(odd).collect()
    assert len(found) == len(ODD)
    sizes = sorted(len(WORD.findall(r[1] or "")) for r in ODD)
    assert sorted(r["size"] for r in found) == sizes
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    by_source = {}
    for r in found:
        by_source.setdefault(r["source"], []).append(r)
    for part in by_source.values():
        assert sum(r["taken"] for r in part) == math.floor(part[0]["target"])
        assert part[0]["source_size"] == sum(r["size"] for r in part)


def test_positions_follow_the_schedule(docs):
    """Up to each time, a source has given as many words as the integral of its rate."""
    found = [r for r in mixing.mix(docs, slopes=(-0.4, 0.0, 0.4)).collect() if r["taken"]]
    total = sum(r["taken"] for r in found)
    for r in found:
        for p in (r["first_position"], r["second_position"]):
            assert p is None or 0 <= p <= 1
        if r["second_position"] is not None:
            assert r["first_position"] < r["second_position"]
    # All rates together are even: half of the words come in the first half.
    early = sum(r["size"] for r in found for p in (r["first_position"], r["second_position"])
                if p is not None and p < 0.5)
    assert abs(early / total - 0.5) < 0.1


def demand(t, target, slope):
    """Words wanted of a source up to the time ``t``: its rate, summed over small steps."""
    times = (np.arange(20_000) + 0.5) * t / 20_000
    return (target * (1 + slope * (2 * times - 1))).mean() * t


def test_query_reads_the_sorted_order(spark, docs, monkeypatch):
    """The query's rows come from positions at which the demand reaches each document, sorted
    from file to file, and not from the streams alone."""
    tables = []
    monkeypatch.setattr(mixing, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    found = QUERIES["op7_mixing"](spark, SF_DIR).collect()
    order = tables[-1]
    files = {}
    for r in order.withColumn("file", F.input_file_name()).collect():
        files.setdefault(r["file"], []).append(r)
    order = [r for f in sorted(files) for r in files[f]]
    taken = [r for r in order if r["position"] is not None]
    assert [r["position"] for r in taken] == sorted(r["position"] for r in taken)
    assert order[:len(taken)] == taken
    words = {}
    for r in order:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + (r["words"] or 0)
    assert words == {r["doc_id"]: r["taken"] for r in found}
    # Each source's words come one after another, where its demand reaches them.
    targets = dict(sorted({r["source"]: r["target"] for r in order}.items()))
    slopes = dict(zip(targets, [-0.4, 0.0, 0.4] * len(targets)))
    mean = sum(slopes[s] * targets[s] for s in targets) / sum(targets.values())
    for s in targets:
        begun = 0
        for r in (r for r in taken if r["source"] == s):
            assert np.isclose(demand(r["position"], targets[s], slopes[s] - mean), begun,
                              rtol=1e-6, atol=1e-3)
            begun += r["words"]
        assert begun == math.floor(targets[s])


def test_order_keeps_equal_rows_and_all_passes(spark):
    table = spark.createDataFrame(
        [(1, "", "a"), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a"), (None, None, "b"),
         *[(i, "u v w", "b") for i in range(10, 40)]], "doc_id long, text string, source string")
    found = mixing.mix(table, weights=(9, 1), share=1.2, limit=3.0).collect()
    assert sorted((r["doc_id"] or 0, r["taken"]) for r in found)[:5] == [
        (0, 0), (1, 0), (1, 0), (2, 6), (2, 6)]
    order = mixing.training_order(table, weights=(9, 1), share=1.2, limit=3.0)
    assert sorted(r["epoch"] for r in order.where("doc_id = 2").collect()) == [1, 1, 2, 2, 3, 3]


def test_training_order(spark, odd, clashing, docs):
    found = mixing.training_order(clashing)
    assert found.columns[:len(clashing.columns)] == clashing.columns
    placed = mixing.mix(odd).select(F.explode(F.array("first_position", "second_position")).alias("p"))
    assert found.count() == placed.where("p is not null").count()
    order = [r[0] for r in mixing.training_order(docs).select("position").collect()]
    assert order == sorted(order)


def test_mix_again_is_equal(docs):
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(5)))


def test_empty_mix(nothing):
    assert mixing.mix(nothing).count() == 0
    assert mixing.training_order(nothing).count() == 0


def test_pipeline(spark, docs):
    kept, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.written(stage(spark, kept, SF_DIR), "test")
        assert path.columns == columns, name
        kept = path
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR)
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert rows(whole.select("doc_id", "position", "epoch")) == rows(
        last.select("doc_id", "position", "epoch"))
