import os
import random
import subprocess
import sys
from datetime import date

import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.plans.shaping import WORDS
from tidemark.sources.readers import PRICE_SCHEMA


def test_words_in_order(spark):
    rows = tm.sort_values(tm.literal(spark, [(w,) for w in WORDS], "value string")).collect()
    assert [r.value for r in rows] == ["Hello,", "dog", "elephant", "panther", "world!"]


def test_lines_in_order(spark, tmp_path):
    rng = random.Random(4)
    lines = [rng.choice("abcXYZ") * rng.randint(0, 3) for _ in range(500)] + ["hot"] * 400
    rng.shuffle(lines)
    (tmp_path / "one.txt").write_text("\n".join(lines[:450]) + "\n")
    (tmp_path / "two.txt").write_text("\n".join(lines[450:]) + "\n")
    got = tm.sort_values(tm.read_lines(spark, str(tmp_path)))
    assert [r.value for r in got.collect()] == sorted(lines)


@pytest.mark.parametrize("blocks", [2, 7, 256])
def test_ranks(spark, blocks):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcde", k=2)) for _ in range(300)] + ["mm"] * 150
    df = spark.createDataFrame([(w,) for w in words], "value string")
    got = tm.rank_values(df, partitions=blocks).collect()
    ordered = sorted(words)
    assert {(r.value, r.copies, r.first_rank) for r in got} == {
        (w, words.count(w), ordered.index(w) + 1) for w in set(words)
    }


def test_a_hot_value_is_sorted_by_several_tasks(spark):
    df = spark.range(0, 80_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("value")
    )
    with_tasks = tm.sort_values(df).select("value", F.spark_partition_id().alias("task"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert with_tasks.where("value = 'hot'").select("task").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_price_file(spark, tmp_path):
    head = "Date,High,Low,Open,Close,Volume,Adj Close"
    (tmp_path / "p.csv").write_text(head + "\n2019-04-18,2,1,1.5,1.75,900,1.7\n2019-04-22,3,2,2.5,2.75,800,2.7\n")
    typed = tm.read_csv(spark, str(tmp_path), PRICE_SCHEMA)
    assert [t for _, t in typed.dtypes] == ["date", "double", "double", "double", "double", "bigint",
                                            "double"]
    rows = tm.to_series(typed.withColumn("k", F.lit("s")), "k", "Date", "Adj Close").collect()
    assert [(r.ds, r.y) for r in rows] == [(date(2019, 4, 18), 1.7), (date(2019, 4, 22), 2.7)]
    text = tm.read_csv(spark, str(tmp_path))
    assert {t for _, t in text.dtypes} == {"string"}
    guessed = tm.read_csv(spark, str(tmp_path), infer=True)
    assert dict(guessed.dtypes)["Volume"] == "int"


def test_csv_round_trip(spark, tmp_path, panel):
    path = str(tmp_path / "out")
    tm.write_csv(panel, path, sep="|")
    back = tm.read_csv(spark, path, "series_id string, ds date, y double", sep="|")
    assert back.exceptAll(panel).count() == 0 and back.count() == panel.count()


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"k": 5, "z": "a"}'), (2, "broken")], "id int, t string")
    rows = tm.parse_json_records(df, "t", "k int, z string", keep=["id"]).collect()
    assert [tuple(r) for r in rows] == [(1, 5, "a"), (2, None, None)]
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    assert sorted(r.k for r in tm.read_json(spark, str(tmp_path), "k int").collect()) == [1, 2]


PEOPLE = [
    ("north", "Ada", "a@x", 100), ("north", "Bo", "b@x", 120),
    ("south", "Cy", "c@x", 140), ("south", None, "d@x", 160),
]


def test_nesting(spark):
    df = spark.createDataFrame(PEOPLE, "dept string, firstName string, email string, salary long")
    fields = ["firstName", "email", "salary"]
    rows = tm.nest(df, "dept", (), fields, "employees", order="salary")
    got = {r.dept: r.employees for r in rows.collect()}
    assert [p.firstName for p in got["north"]] == ["Ada", "Bo"]
    assert got["south"][1].asDict() == {"firstName": None, "email": "d@x", "salary": 160}
    first = tm.first_element(rows, "employees", "email").select("dept", "email").collect()
    assert {tuple(r) for r in first} == {("north", "a@x"), ("south", "c@x")}
    empty = rows.withColumn("employees", F.filter("employees", lambda e: e["salary"] < 0))
    assert {r.email for r in tm.first_element(empty, "employees", "email").collect()} == {None}


def test_a_hot_key_is_laid_out_and_has_one_first_element(spark):
    df = spark.range(300_000).select(
        F.lit("hot").alias("k"), (F.lit(300_000) - F.col("id")).alias("id"),
        F.floor(F.col("id") / 1000).alias("block"))
    df = df.union(spark.createDataFrame([("cold", 5, 0), ("none", None, 1)], "k string, id long, block long"))
    rows = tm.nest(df, "k", "block", ["id"], "items", order="id")
    hot = rows.where("k = 'hot'")
    assert hot.count() == 300
    assert hot.selectExpr("max(size(items))", "sum(size(items))").first()[:] == (1000, 300_000)
    first = {r.k: (r.id, r.block) for r in tm.first_of(df, "k", ["id", "block"], "id").collect()}
    assert first == {"hot": (1, 299), "cold": (5, 0), "none": (None, 1)}


def test_nested_literal_rows_with_nulls(spark):
    rows = [(("1", "math"), [("Ada", None, "a@x", 100), (None, None, None, None)]), (None, None)]
    df = tm.literal(spark, rows, "department struct<id:string,name:string>, "
                    "employees array<struct<firstName:string,lastName:string,email:string,salary:long>>")
    got = tm.first_element(df, "employees", "firstName", "first").select("department.name", "first")
    assert [tuple(r) for r in got.collect()] == [("math", "Ada"), (None, None)]
    assert df.first().employees[1].asDict() == dict.fromkeys(("firstName", "lastName", "email", "salary"))


def test_scratch_follows_the_session(spark, tmp_path):
    assert tm.scratch_path(spark, "x") != tm.scratch_path(spark, "x")


PROGRAM = """
import pickle, sys
sys.path.insert(0, sys.argv[1])  # the zip, as Spark puts it on a worker's path
function = pickle.load(open(sys.argv[2], "rb"))
import tidemark
assert sys.argv[1] in tidemark.__file__
import pandas as pd
rows = pd.DataFrame({"k": ["a"] * 40, "_block": 0, "_pos": range(1, 41), "_top": 2, "_own": True,
                     "_dy": [0.5, -0.25] * 20, "_level": [float(i % 7) for i in range(40)]})
print("rows", len(function(("a", 0), rows)))
"""


def test_shipped_package_serves_a_worker(spark, tmp_path):
    """A process elsewhere, with nothing but the zip, runs a function that was pickled by reference,
    as a worker of an executor does."""
    from pyspark import cloudpickle
    from tidemark.operators import diagnostics
    from tidemark.session import ship
    zipped = ship(spark)
    assert any(zipped.endswith(os.path.basename(f)) for f in spark.sparkContext.listFiles)
    (tmp_path / "function").write_bytes(cloudpickle.dumps(diagnostics._partial_sums(["k"])))
    (tmp_path / "run.py").write_text(PROGRAM)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py", zipped, "function"], cwd=tmp_path,
                          env=env, capture_output=True, text=True, timeout=120)
    assert "rows 4" in done.stdout, done.stderr[-2000:]
