"""Queries on sources, projection, aggregation, resampling and transforms."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions.columns import parse_date
from tidemark.operators.decompose import decompose
from tidemark.operators.describe import describe, group_mean
from tidemark.operators.evaluate import plot_frame, stack
from tidemark.operators.ordering import rank_values, sort_values
from tidemark.operators.resample import bucket_sums, means_of_sums, resample
from tidemark.operators.series import date_range, drop_missing, head, slice_end, tail, to_series
from tidemark.operators.transforms import difference, exp, integrate, log, rolling
from tidemark.plans.inputs import (
    CENTS,
    DAILY_SQL,
    DAY_SQL,
    KEY,
    PRIORITY_INDEX_SQL,
    SUPPLIER_SQL,
    WEEKLY_SQL,
    mean_sql,
    order_values,
    panel,
    priority_index,
    r6_sql,
    supplier_panel,
    table,
)
from tidemark.plans.registry import query, r6, rounded
from tidemark.sources.nested import first_of, nest
from tidemark.sources.panels import read_panel, write_panel
from tidemark.sources.readers import literal, parse_json_records, read_csv, read_json, read_lines
from tidemark.sources.writers import scratch_path, write_csv, write_lines

# The five words of the sorting example.
WORDS = ["Hello,", "world!", "dog", "elephant", "panther"]

ORDERS_CSV = "o_orderkey bigint, day date, o_orderpriority string, o_totalprice double"
ORDERS_CSV_SQL = f"SELECT o_orderkey, {DAY_SQL} AS day, o_orderpriority, o_totalprice FROM orders"


def _orders_as_csv(spark, sf_dir, sep=","):
    path = scratch_path(spark, "orders-csv")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_totalprice"
    )
    write_csv(rows, path, sep=sep)
    return path


@query(ORDERS_CSV_SQL)
def scan_csv_typed(spark, sf_dir):
    return read_csv(spark, _orders_as_csv(spark, sf_dir, ";"), ORDERS_CSV, sep=";")


@query(ORDERS_CSV_SQL)
def scan_csv_inferred(spark, sf_dir):
    rows = read_csv(spark, _orders_as_csv(spark, sf_dir), infer=True)
    return rows.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query(f"""SELECT cast(o_orderkey as varchar) AS o_orderkey, cast({DAY_SQL} as varchar) AS day,
  o_orderpriority, o_totalprice FROM orders""")
def scan_csv_text(spark, sf_dir):
    """All columns read as text; the price cast afterwards."""
    rows = read_csv(spark, _orders_as_csv(spark, sf_dir))
    return rows.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("""SELECT value, count(*) AS copies FROM (
  SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value""")
def scan_text_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    write_lines(table(spark, sf_dir, "documents").select("text"), path)
    return read_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def scan_text_sorted(spark, sf_dir):
    """The lines of all documents, written as text files and read back in order."""
    path = scratch_path(spark, "lines")
    write_lines(table(spark, sf_dir, "documents").select("text"), path)
    return sort_values(read_lines(spark, path))


@query("""SELECT event_id, cast(json_extract_string(props, '$.k') as integer) AS k FROM events""")
def scan_json_records(spark, sf_dir):
    return parse_json_records(table(spark, sf_dir, "events"), "props", "k int", keep=["event_id"])


@query("SELECT event_id, event_type, value FROM events")
def scan_json_files(spark, sf_dir):
    path = scratch_path(spark, "events-json")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.json(path)
    return read_json(spark, path, "event_id bigint, event_type string, value double")


@query(f"""SELECT value, count(*) AS copies,
  cast(sum(count(*)) OVER (ORDER BY value) - count(*) + 1 AS bigint) AS first_rank
  FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part UNION ALL
        SELECT unnest({WORDS!r}))
  GROUP BY value""")
def literal_words_sorted(spark, sf_dir):
    """The literal words together with the words of all part names, sorted."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("value"))
    return rank_values(stack(words, literal(spark, [(w,) for w in WORDS], "value string")))


@query("""SELECT value, count(*) AS copies,
  cast(sum(count(*)) OVER (ORDER BY value) - count(*) + 1 AS bigint) AS first_rank
  FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value""")
def text_lines_ranked(spark, sf_dir):
    """The place of every line of all documents in the sorted list."""
    lines = table(spark, sf_dir, "documents").select(
        F.explode(F.split("text", "\n")).alias("value")
    )
    return rank_values(lines)


NESTED_FIELDS = {"key": "o_orderkey", "day": "day", "price": "o_totalprice"}


def _orders_with_day(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumns(
        {"day": F.to_date("o_orderdate"), "year": F.year("o_orderdate")})


@query(f"""SELECT c_custkey, cast(year({DAY_SQL}) AS integer) AS year, any_value(c_name) AS name,
  any_value(c_mktsegment) AS segment,
  coalesce(string_agg(o_orderkey || '|' || {DAY_SQL} || '|' || printf('%.2f', o_totalprice), ','
    ORDER BY o_orderkey), '') AS listed
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def nested_customer_orders(spark, sf_dir):
    """Each customer as a struct with the arrays of its orders, laid out by year, shown as text."""
    arrays = nest(_orders_with_day(spark, sf_dir), "o_custkey", "year", NESTED_FIELDS, "orders",
                  order="key")
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.struct("c_name", "c_mktsegment").alias("customer")
    )
    line = F.transform(
        "orders", lambda o: F.concat_ws("|", o["key"], o["day"], F.printf(F.lit("%.2f"), o["price"]))
    )
    return customers.join(arrays, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "year", F.col("customer.c_name").alias("name"),
        F.col("customer.c_mktsegment").alias("segment"),
        F.coalesce(F.array_join(line, ","), F.lit("")).alias("listed"),
    )


@query(f"""SELECT c_custkey, cast(year(arg_min({DAY_SQL}, o_orderkey)) AS integer) AS year,
  min(o_orderkey) AS key, arg_min({DAY_SQL}, o_orderkey) AS day,
  arg_min(o_totalprice, o_orderkey) AS price
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def nested_first_element(spark, sf_dir):
    """The first order of each customer, with the year it is laid out under."""
    first = first_of(_orders_with_day(spark, sf_dir), "o_custkey", {"year": "year", **NESTED_FIELDS},
                     order="o_orderkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query(f"WITH {WEEKLY_SQL} SELECT series_id, ds, y FROM weekly")
def sink_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "weekly-csv")
    write_csv(panel(spark, sf_dir), path)
    return read_csv(spark, path, "series_id string, ds date, y double")


LAST_DAY = date(2001, 8, 1)


@query(f"""SELECT o_orderpriority AS series_id, {DAY_SQL} AS ds, o_totalprice AS y FROM orders
  WHERE {DAY_SQL} BETWEEN date '1998-08-01' AND date '2001-08-01'""")
def panel_three_years(spark, sf_dir):
    """All order values laid out by month, and the last three years read back."""
    path = scratch_path(spark, "panel")
    write_panel(order_values(spark, sf_dir), path)
    return read_panel(spark, path, start=date(1998, 8, 1), end=LAST_DAY).select(KEY, "ds", "y")


@query(f"""SELECT o_orderkey, {DAY_SQL} AS day, o_totalprice FROM orders
  WHERE {DAY_SQL} BETWEEN date '1998-08-01' AND date '2001-08-01'""")
def range_last_3y(spark, sf_dir):
    rows = date_range(table(spark, sf_dir, "orders"), "o_orderdate", end=LAST_DAY, months=36)
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


@query(f"""SELECT cast({DAY_SQL} AS varchar) AS ds,
  {r6_sql('cast(cast(o_totalprice AS float) AS double)', 3)} AS y FROM orders""")
def project_cast_alias(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").cast("string").alias("ds"),
        F.col("o_totalprice").cast("float").alias("y"),
    )
    return rows.withColumn("y", r6(F.col("y").cast("double"), 3))


@query(f"""SELECT o_orderkey, {DAY_SQL} AS ds, {DAY_SQL} AS from_slashes,
  cast(NULL AS date) AS from_priority FROM orders""")
def parse_dates(spark, sf_dir):
    """Dates written out as text in two layouts and parsed; other text gives NULL."""
    day = F.to_date("o_orderdate")
    text = table(spark, sf_dir, "orders").select(
        "o_orderkey", day.cast("string").alias("a"), F.date_format(day, "dd/MM/yyyy").alias("b"),
        "o_orderpriority",
    )
    return text.select(
        "o_orderkey", parse_date(F.col("a")).alias("ds"),
        parse_date(F.col("b"), "dd/MM/yyyy").alias("from_slashes"),
        parse_date(F.col("o_orderpriority")).alias("from_priority"),
    )


def _placed_sql(direction: str) -> str:
    return f"""SELECT o_orderpriority, o_orderkey, {DAY_SQL} AS ds, row_number() OVER (
      PARTITION BY o_orderpriority ORDER BY o_orderdate {direction}, o_orderkey {direction}) AS spot
    FROM orders"""


def _raw_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderkey", F.to_date("o_orderdate").alias("ds")
    )


@query(f"SELECT * EXCLUDE (spot) FROM ({_placed_sql('ASC')}) WHERE spot <= 5")
def head_per_series(spark, sf_dir):
    return head(_raw_orders(spark, sf_dir), "o_orderpriority", 5, ["ds", "o_orderkey"])


@query(f"SELECT * EXCLUDE (spot) FROM ({_placed_sql('DESC')}) WHERE spot <= 6")
def tail_per_series(spark, sf_dir):
    return tail(_raw_orders(spark, sf_dir), "o_orderpriority", 6, ["ds", "o_orderkey"])


@query(f"SELECT * EXCLUDE (spot) FROM ({_placed_sql('DESC')}) WHERE spot > 5 AND spot <= 70")
def slice_from_end(spark, sf_dir):
    return slice_end(_raw_orders(spark, sf_dir), "o_orderpriority", 70, 5, ["ds", "o_orderkey"])


@query(f"""SELECT o_orderkey, o_orderpriority, {DAY_SQL} AS ds FROM orders
  ORDER BY o_orderdate, o_orderkey LIMIT 5""")
def head_of_table(spark, sf_dir):
    return head(_raw_orders(spark, sf_dir), None, 5, ["ds", "o_orderkey"])


@query(f"""SELECT o_orderkey, o_orderpriority, {DAY_SQL} AS ds FROM orders
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 6""")
def tail_of_table(spark, sf_dir):
    return tail(_raw_orders(spark, sf_dir), None, 6, ["ds", "o_orderkey"])


@query("""WITH weekly AS (SELECT c_nationkey AS series_id, {w} AS ds, {m} AS y
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
  SELECT series_id, ds, y FROM weekly""".format(
    w="cast(cast(o_orderdate as date) + ((7 - isodow(o_orderdate)) % 7) * interval 1 day as date)",
    m="cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*)"))
def drop_missing_weeks(spark, sf_dir):
    """Weekly means per nation, gaps filled with NULL and dropped again. Orders are summed by
    customer and week before they meet the customers, so that no raw rows are joined."""
    orders = to_series(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    sums = bucket_sums(orders, "o_custkey", CENTS, freq="W")
    joined = sums.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    weeks = means_of_sums(joined.withColumnRenamed("c_nationkey", KEY), KEY, CENTS, freq="W", gaps="keep")
    return drop_missing(weeks)


@query(f"""SELECT {DAY_SQL} AS ds, {mean_sql('o_totalprice')} AS mean_y
  FROM orders GROUP BY 1""")
def group_mean_daily(spark, sf_dir):
    return group_mean(order_values(spark, sf_dir), "ds", places=CENTS)


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c, extra=""):
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", {r6_sql(f'avg({c})', 4)} AS mean,
      {r6_sql(f'stddev_samp({c})', 4)} AS std, min({c}) AS min, max({c}) AS max{extra} FROM lineitem"""


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *DESCRIBED]
TEXTS = ["l_returnflag", "l_linestatus"]


@query(" UNION ALL ".join(_describe_sql(
    c, ", cast(NULL AS varchar) AS min_text, cast(NULL AS varchar) AS max_text") for c in NUMBERS)
    + "".join(f""" UNION ALL SELECT '{c}', count({c}), NULL, NULL, NULL, NULL,
      min({c}), max({c}) FROM lineitem""" for c in TEXTS))
def describe_basic(spark, sf_dir):
    """Every numeric and text column."""
    return rounded(describe(table(spark, sf_dir, "lineitem")), "mean", "std", places=4)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS "count", NULL::double AS mean,
    NULL::double AS min, NULL::double AS max, min({c}) AS min_text, max({c}) AS max_text FROM part"""
    if t else f"""SELECT '{c}', count({c}), {r6_sql(f'avg({c})', 4)}, min({c}), max({c}), NULL, NULL
    FROM part""" for c, t in (("p_name", 1), ("p_brand", 1), ("p_type", 1), ("p_partkey", 0),
                              ("p_size", 0), ("p_retailprice", 0))))
def describe_text(spark, sf_dir):
    """Every column of a table that has mostly text."""
    return rounded(describe(table(spark, sf_dir, "part")), "mean", places=4).drop("std")


@query(" UNION ALL ".join(_describe_sql(c, "".join(
    f", {r6_sql(f'quantile_cont({c}, {p})', 4)} AS {n}"
    for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))) for c in DESCRIBED))
def describe_quartiles(spark, sf_dir):
    rows = describe(table(spark, sf_dir, "lineitem"), DESCRIBED, quartiles=True)
    return rounded(rows, "mean", "std", "q25", "q50", "q75", places=4).drop("min_text", "max_text")


@query("""SELECT event_type, 'value' AS "column", count(value) AS "count", """ + ", ".join(
    f"{r6_sql(f'quantile_cont(value, {p})', 4)} AS {n}"
    for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))) + " FROM events GROUP BY event_type")
def describe_quartiles_by_key(spark, sf_dir):
    rows = describe(table(spark, sf_dir, "events"), ["value"], by="event_type", quartiles=True)
    return rounded(rows, "q25", "q50", "q75", places=4).select(
        "event_type", "column", "count", "q25", "q50", "q75"
    )


@query(f"WITH {DAILY_SQL} SELECT series_id, ds, y FROM daily")
def resample_daily(spark, sf_dir):
    return panel(spark, sf_dir, "D")


def _gaps_sql(cte: str, name: str, step: str) -> str:
    return f"""WITH {cte}, span AS (
      SELECT series_id, unnest(generate_series(min(ds), max(ds), interval {step})) AS at
      FROM {name} GROUP BY series_id)
    SELECT s.series_id, cast(s.at AS date) AS ds, y
    FROM span s LEFT JOIN {name} v ON v.series_id = s.series_id AND v.ds = cast(s.at AS date)"""


@query(_gaps_sql(DAILY_SQL, "daily", "1 day"))
def resample_daily_gaps(spark, sf_dir):
    return panel(spark, sf_dir, "D", gaps="keep")


@query(f"WITH {WEEKLY_SQL} SELECT series_id, ds, y FROM weekly")
def resample_weekly(spark, sf_dir):
    return panel(spark, sf_dir)


@query(_gaps_sql(WEEKLY_SQL, "weekly", "7 days"))
def resample_weekly_gaps(spark, sf_dir):
    return panel(spark, sf_dir, gaps="keep")


@query(f"WITH {WEEKLY_SQL} SELECT series_id, ds, {r6_sql('ln(y)')} AS y FROM weekly")
def log_transform(spark, sf_dir):
    return rounded(log(panel(spark, sf_dir)), "y")


@query(f"WITH {PRIORITY_INDEX_SQL} SELECT series_id, ds, {r6_sql('exp(y)', 4)} AS y FROM levels")
def exp_transform(spark, sf_dir):
    """The log index back on its level."""
    return rounded(exp(priority_index(spark, sf_dir)), "y", places=4)


@query(f"""WITH {WEEKLY_SQL}, diffs AS (
    SELECT series_id, ds, ln(y) - lag(ln(y)) OVER (PARTITION BY series_id ORDER BY ds) AS w
    FROM weekly)
  SELECT series_id, ds, {r6_sql('w')} AS w FROM diffs WHERE w IS NOT NULL""")
def log_diff(spark, sf_dir):
    rows = difference(log(panel(spark, sf_dir)), KEY, d=1)
    return rounded(drop_missing(rows, "w"), "w").select(KEY, "ds", "w")


@query(f"""WITH {WEEKLY_SQL}, once AS (
    SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS w1 FROM weekly), twice AS (
    SELECT *, w1 - lag(w1) OVER (PARTITION BY series_id ORDER BY ds) AS w2 FROM once)
  SELECT series_id, ds, {r6_sql('w2')} AS w FROM twice""")
def diff_order2(spark, sf_dir):
    return rounded(difference(panel(spark, sf_dir), KEY, d=2), "w").select(KEY, "ds", "w")


@query(f"""WITH {PRIORITY_INDEX_SQL}, placed AS (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS pos FROM levels)
  SELECT series_id, ds, {r6_sql('CASE WHEN pos > 2 THEN y END')} AS level FROM placed""")
def integrate_levels(spark, sf_dir):
    """Differencing twice and integrating gives the levels back."""
    rows = integrate(difference(priority_index(spark, sf_dir), KEY, d=2), KEY, "w", 2)
    return rounded(rows, "level").select(KEY, "ds", "level")


def _rolling_sql(fn, out):
    return f"""WITH {WEEKLY_SQL}, rolled AS (
      SELECT series_id, ds, {fn}(y) OVER f AS v, count(y) OVER f AS c FROM weekly
      WINDOW f AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
    SELECT series_id, ds, {r6_sql('CASE WHEN c = 52 THEN v END', 5)} AS {out} FROM rolled"""


@query(_rolling_sql("avg", "rolling_mean"))
def rolling_mean_52(spark, sf_dir):
    rows = rolling(panel(spark, sf_dir), KEY, stats=["mean"]).drop("y")
    return rounded(rows, "rolling_mean", places=5)


@query(_rolling_sql("stddev_samp", "rolling_std"))
def rolling_std_52(spark, sf_dir):
    rows = rolling(panel(spark, sf_dir), KEY, stats=["std"]).drop("y")
    return rounded(rows, "rolling_std", places=5)


PARTS_STEPS = f"""{WEEKLY_SQL}, placed AS (
    SELECT series_id, ds, ln(y) AS y, row_number() OVER o AS pos,
      count(*) OVER (PARTITION BY series_id) AS n
    FROM weekly WINDOW o AS (PARTITION BY series_id ORDER BY ds)), trends AS (
    SELECT *, CASE WHEN n >= 104 AND pos > 26 AND pos <= n - 26 THEN
      (sum(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)
       + 0.5 * lag(y, 26) OVER o + 0.5 * lead(y, 26) OVER o) / 52 END AS trend
    FROM placed WINDOW o AS (PARTITION BY series_id ORDER BY ds)), means AS (
    SELECT series_id, (pos - 1) % 52 AS phase, avg(y - trend) AS m FROM trends GROUP BY 1, 2),
  centres AS (SELECT series_id, avg(m) AS c FROM means GROUP BY 1), parts AS (
    SELECT t.series_id, t.ds, t.y, t.trend, m.m - c.c AS seasonal FROM trends t
    JOIN means m ON m.series_id = t.series_id AND m.phase = (t.pos - 1) % 52
    JOIN centres c ON c.series_id = t.series_id)"""
PARTS_SQL = f"WITH {PARTS_STEPS} SELECT series_id, ds, "


def _parts(spark, sf_dir):
    return decompose(log(panel(spark, sf_dir)), KEY, period=52)


@query(PARTS_SQL + f"{r6_sql('trend')} AS trend FROM parts")
def decompose_trend(spark, sf_dir):
    return rounded(_parts(spark, sf_dir), "trend").select(KEY, "ds", "trend")


@query(PARTS_SQL + f"{r6_sql('seasonal')} AS seasonal FROM parts")
def decompose_seasonal(spark, sf_dir):
    return rounded(_parts(spark, sf_dir), "seasonal").select(KEY, "ds", "seasonal")


@query(PARTS_SQL + f"{r6_sql('y - trend - seasonal')} AS resid FROM parts")
def decompose_resid(spark, sf_dir):
    return rounded(_parts(spark, sf_dir), "resid").select(KEY, "ds", "resid")


@query(f"""WITH {PARTS_STEPS}, tails AS (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS spot FROM parts)
  SELECT series_id, ds, panel, {r6_sql('value')} AS value FROM (
    SELECT series_id, ds, spot, unnest(['original', 'trend', 'seasonal', 'residual']) AS panel,
      unnest([y, trend, seasonal, y - trend - seasonal]) AS value FROM tails) WHERE spot <= 80""")
def plot_decomposition(spark, sf_dir):
    """The last 80 weeks of the parts as one long frame for a chart."""
    panels = {"original": "y", "trend": "trend", "seasonal": "seasonal", "residual": "resid"}
    last = slice_end(_parts(spark, sf_dir), KEY, 80)
    return rounded(plot_frame(last, KEY, panels), "value")


@query(f"""SELECT event_type, cast(ts AS date) AS ds, {r6_sql('avg(value)', 5)} AS y
  FROM events GROUP BY 1, 2""")
def resample_event_days(spark, sf_dir):
    rows = to_series(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    return rounded(resample(rows, "event_type"), "y", places=5)


@query(f"""WITH {SUPPLIER_SQL}, framed AS (
    SELECT series_id, ds, avg(ln(y)) OVER f AS m, count(*) OVER f AS c, ln(y) - lag(ln(y)) OVER o AS w FROM weekly
    WINDOW o AS (PARTITION BY series_id ORDER BY ds), f AS (o ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
  SELECT series_id, ds, {r6_sql('w')} AS w, {r6_sql('CASE WHEN c = 52 THEN m END')} AS rolling_mean FROM framed""")
def rolling_in_blocks(spark, sf_dir):
    """Differences and rolling means of every supplier's logs, each series cut into blocks of 64 rows."""
    rows = difference(log(supplier_panel(spark, sf_dir)), KEY, block_rows=64)
    rows = rolling(rows, KEY, window=52, stats=("mean",), block_rows=64)
    return rounded(rows.select(KEY, "ds", "w", "rolling_mean"), "w", "rolling_mean")
