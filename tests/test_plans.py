"""What the physical plans look like."""

import pytest
from pyspark.sql import functions as F

import tidemark as tm
from conftest import SF_DIR
from tidemark.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["forecast_ar1_d1", "forecast_ma1_d1", "forecast_arima_111_nc",
                                  "forecast_arima_310", "forecast_arima_013", "forecast_arima_211",
                                  "decompose_resid", "rolling_mean_52", "resample_daily_gaps"])
def test_two_shuffles_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") == 2
    assert "Python" not in text and "partial_" in text


def test_large_orders_use_arrow_batches(panel):
    text = plan(tm.walk_forward(panel, "series_id", order=(4, 1, 2)))
    assert "ArrowEvalPython" in text and "BatchEvalPython" not in text


def test_grid_is_one_pass(spark):
    text = plan(QUERIES["grid_search_rmse"](spark, SF_DIR))
    assert text.count("Scan parquet") == 1
    assert text.count("Exchange hashpartitioning") == 3
    assert text.count("MapInPandas") == 1 and "EvalPython" not in text


@pytest.mark.parametrize("name", ["head_per_series", "tail_per_series", "slice_from_end"])
def test_rows_are_limited_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["head_of_table", "tail_of_table"])
def test_head_of_a_table_is_a_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF_DIR))


def test_date_range_reaches_the_scan(spark):
    text = QUERIES["range_last_3y"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_only_needed_columns_are_read(spark):
    text = QUERIES["resample_weekly"](spark, SF_DIR)._jdf.queryExecution().toString()
    schema = text.split("ReadSchema: ")[-1]
    assert "o_custkey" not in schema and "o_orderstatus" not in schema


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_bucketed_panel_is_not_shuffled_again(spark, panel, tmp_path):
    panel.write.option("path", str(tmp_path / "t")).bucketBy(4, "series_id").sortBy(
        "series_id", "ds").saveAsTable("bucketed_panel")
    stored = spark.table("bucketed_panel")
    fit = tm.walk_forward(stored, "series_id", order=(2, 1, 1))
    assert "Exchange" not in plan(tm.score(fit, "series_id"))
    assert fit.select("yhat").exceptAll(
        tm.walk_forward(panel, "series_id", order=(2, 1, 1)).select("yhat")).count() == 0
    spark.sql("DROP TABLE bucketed_panel")


def test_a_long_series_is_the_work_of_many_tasks(spark):
    """In blocks, one key's rows are spread, and no window goes by the key alone but over counts."""
    df = spark.range(20_000).select(
        F.lit("one").alias("k"), F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).alias("ds"),
        F.sin("id").alias("y"))
    found = tm.rolling(df, "k", window=30, block_rows=500)
    text = plan(found)
    for w in text.split("Window [")[1:]:
        assert "_block" in w.split("\n")[0] or "_span" in w.split("\n")[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it is a small table
    try:
        spread = tm.rolling(df, "k", window=30, block_rows=500).withColumn(
            "p", F.spark_partition_id()).groupBy("p").agg(
            F.count(F.lit(1)).alias("count"), F.sum("rolling_mean"), F.sum("rolling_std")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 4 and max(r["count"] for r in spread) < 10_000
    whole = tm.rolling(df, "k", window=30)
    assert found.count() == 20_000
    both = found.alias("a").join(whole.alias("b"), "ds").where(
        "NOT (a.rolling_mean <=> b.rolling_mean AND a.rolling_std <=> b.rolling_std)")
    assert both.count() == 0


def test_a_span_of_a_panel_reads_its_months(spark, panel, tmp_path):
    from datetime import date
    more = panel.unionByName(spark.createDataFrame([("z", None, 1.0)], panel.schema))
    tm.write_panel(more, str(tmp_path / "p"))
    whole = tm.read_panel(spark, str(tmp_path / "p"))
    assert whole.exceptAll(more).count() == 0 and whole.count() == more.count()
    start, end = date(2020, 6, 10), date(2021, 2, 3)
    some = tm.read_panel(spark, str(tmp_path / "p"), start=start, end=end)
    want = more.where((F.col("ds") >= F.lit(start)) & (F.col("ds") <= F.lit(end)))
    assert some.exceptAll(want).count() == 0 and some.count() == want.count() > 0
    text = plan(some)
    assert "PartitionFilters: [isnotnull(month" in text and "month" in text.split("PartitionFilters: ")[1]


def test_orders_are_summed_before_the_join(spark):
    text = plan(QUERIES["drop_missing_weeks"](spark, SF_DIR))
    joined = text[text.index("Join"):]
    assert "HashAggregate" in joined and "partial_sum" in joined
