"""Queries on the additive model and its regressors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import units
from tidemark.operators.additive import additive_components, additive_forecast, scaled_rows
from tidemark.operators.calendars import country_holidays
from tidemark.operators.evaluate import plot_frame, score, stack
from tidemark.operators.features import fourier, future_frame, hinges, holiday_flags
from tidemark.plans.inputs import CENTS, DAILY_SQL, DAY_SQL, KEY, WEEKLY_SQL, panel, r6_sql, table
from tidemark.plans.registry import query, r6, rounded
from tidemark.plans.sqladditive import additive_steps


def peak_days(spark, sf_dir, name: str, measure) -> DataFrame:
    """A holiday table: the day of each year on which ``measure`` is largest."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(
        measure.alias("m")
    )
    rank = F.struct("m", (-F.datediff("ds", F.lit("1970-01-01").cast("date"))).alias("early"))
    return days.groupBy(F.year("ds").alias("_year")).agg(F.max_by("ds", rank).alias("ds")).select(
        F.lit(name).alias("holiday"), "ds",
        F.lit(-1).alias("lower_window"), F.lit(1).alias("upper_window"),
    )


def holidays(spark, sf_dir) -> DataFrame:
    cents = units(F.col("o_totalprice"), CENTS)
    return stack(peak_days(spark, sf_dir, "most_orders", F.count(F.lit(1))),
                 peak_days(spark, sf_dir, "highest_value", F.sum(cents)))


def _peak_sql(name, measure):
    return f"""SELECT '{name}' AS holiday, ds, -1 AS lower_window, 1 AS upper_window FROM (
      SELECT ds, row_number() OVER (PARTITION BY year(ds) ORDER BY m DESC, ds) AS spot FROM (
        SELECT {DAY_SQL} AS ds, {measure} AS m FROM orders GROUP BY 1)) WHERE spot = 1"""


HOLIDAYS_SQL = "holidays AS ({} UNION ALL {})".format(
    _peak_sql("most_orders", "count(*)"),
    _peak_sql("highest_value", "sum(cast(o_totalprice AS decimal(18,2)))"),
)


@query(f"WITH {HOLIDAYS_SQL} SELECT * FROM holidays")
def union_holidays(spark, sf_dir):
    return holidays(spark, sf_dir)


# Public holidays as conditions on a day, where the operator goes from rules to days.
US_SQL = """
  CASE WHEN m = 1 AND d = 1 THEN 'New Year''s Day'
    WHEN m = 1 AND w = 1 AND d BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day'
    WHEN m = 2 AND w = 1 AND d BETWEEN 15 AND 21 THEN 'Washington''s Birthday'
    WHEN m = 5 AND w = 1 AND d >= 25 THEN 'Memorial Day'
    WHEN m = 6 AND d = 19 AND y >= 2021 THEN 'Juneteenth'
    WHEN m = 7 AND d = 4 THEN 'Independence Day'
    WHEN m = 9 AND w = 1 AND d <= 7 THEN 'Labor Day'
    WHEN m = 10 AND w = 1 AND d BETWEEN 8 AND 14 THEN 'Columbus Day'
    WHEN m = 11 AND d = 11 THEN 'Veterans Day'
    WHEN m = 11 AND w = 4 AND d BETWEEN 22 AND 28 THEN 'Thanksgiving'
    WHEN m = 12 AND d = 25 THEN 'Christmas Day' END"""
FIXED_DAYS = "'New Year''s Day', 'Juneteenth', 'Independence Day', 'Veterans Day', 'Christmas Day'"
DAYS_SQL = f"""days AS (
  SELECT cast(ds AS date) AS ds, month(ds) AS m, day(ds) AS d, year(ds) AS y, isodow(ds) AS w FROM (
    SELECT unnest(generate_series(make_date(a, 1, 1), make_date(b + 1, 12, 31), interval 1 day)) AS ds
    FROM (SELECT min(year({DAY_SQL})) AS a, max(year({DAY_SQL})) AS b FROM orders)))"""


@query(f"""WITH {DAYS_SQL}, named AS (SELECT {US_SQL} AS holiday, ds, w FROM days)
  SELECT holiday, ds, 0 AS lower_window, 0 AS upper_window FROM named WHERE holiday IS NOT NULL
  UNION ALL SELECT holiday || ' (observed)', cast(ds + CASE w WHEN 7 THEN 1 ELSE -1 END * interval 1 day AS date), 0, 0
  FROM named WHERE holiday IN ({FIXED_DAYS}) AND w >= 6""")
def holidays_us(spark, sf_dir):
    """The public holidays of the United States in the years of the orders and the next."""
    return country_holidays(table(spark, sf_dir, "orders"), "US", "o_orderdate")


# Easter Sundays, as published.
EASTERS = ("1994-04-03 1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04 2000-04-23 2001-04-15 "
           "2002-03-31 2003-04-20 2004-04-11").split()


@query(f"""WITH {DAYS_SQL}, easters AS (SELECT unnest([{', '.join(f"date '{d}'" for d in EASTERS)}]) AS e),
  named AS (SELECT ds, CASE WHEN m = 1 AND d = 1 THEN 'Neujahr' WHEN m = 5 AND d = 1 THEN 'Tag der Arbeit'
    WHEN m = 10 AND d = 3 THEN 'Tag der Deutschen Einheit' WHEN m = 12 AND d = 25 THEN 'Erster Weihnachtstag'
    WHEN m = 12 AND d = 26 THEN 'Zweiter Weihnachtstag' END AS holiday FROM days),
  moving AS (SELECT d.ds, CASE d.ds - e WHEN -2 THEN 'Karfreitag' WHEN 1 THEN 'Ostermontag'
    WHEN 39 THEN 'Christi Himmelfahrt' WHEN 50 THEN 'Pfingstmontag' END AS holiday
    FROM days d JOIN easters ON year(e) = d.y)
  SELECT holiday, ds, -1 AS lower_window, 1 AS upper_window FROM (
    SELECT * FROM named UNION ALL SELECT ds, holiday FROM moving) WHERE holiday IS NOT NULL""")
def holidays_de(spark, sf_dir):
    """Those of Germany, most of which move with Easter, with the days around them."""
    return country_holidays(table(spark, sf_dir, "orders"), "DE", "o_orderdate", lower_window=-1, upper_window=1)


TOUCHED_SQL = """touched AS (
  SELECT DISTINCT holiday, cast(o AS int) AS "offset", cast(ds + o * interval 1 day AS date) AS ds
  FROM holidays, generate_series(-1, 1) t(o))"""


@query(f"""WITH {DAILY_SQL}, {HOLIDAYS_SQL}, {TOUCHED_SQL}
  SELECT series_id, d.ds, holiday, "offset" FROM daily d LEFT JOIN touched h ON d.ds = h.ds""")
def holiday_features(spark, sf_dir):
    days = panel(spark, sf_dir, "D").select(KEY, "ds")
    return holiday_flags(days, holidays(spark, sf_dir))


@query(f"""WITH {WEEKLY_SQL}, angles AS (
    SELECT series_id, ds, k, 2 * pi() * k * (ds - date '1970-01-01') / 365.25::double AS a
    FROM weekly, generate_series(1, 10) t(k))
  SELECT series_id, ds, cast(2 * k - 2 AS int) AS term, {r6_sql('sin(a)')} AS value FROM angles
  UNION ALL SELECT series_id, ds, cast(2 * k - 1 AS int), {r6_sql('cos(a)')} FROM angles""")
def fourier_features(spark, sf_dir):
    """The yearly seasonality, a row per term."""
    rows = fourier(panel(spark, sf_dir).select(KEY, "ds"), period=365.25, k=10)
    return rounded(rows.select(KEY, "ds", F.posexplode("fourier").alias("term", "value")), "value")


TIMES_SQL = f"""{WEEKLY_SQL}, placed AS (
    SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS pos,
      count(*) OVER (PARTITION BY series_id) - 7 AS train FROM weekly), spans AS (
    SELECT series_id, min(ds) AS a, max(ds) AS b, any_value(train) AS train FROM placed
    WHERE pos <= train GROUP BY series_id), times AS (
    SELECT p.series_id, p.ds, p.pos, (p.ds - a) / (b - a)::double AS t FROM placed p
    JOIN spans s USING (series_id)), knots AS (
    SELECT s.series_id, cast(j AS int) AS j, t AS knot FROM spans s, generate_series(1, 23) g(j)
    JOIN times t ON t.series_id = s.series_id AND t.pos = 1 + cast(round_even(
      j * (floor(s.train * 0.8::double) - 1) / 23::double, 0) AS int))"""


@query(f"""WITH {TIMES_SQL}
  SELECT t.series_id, t.ds, cast(j - 1 AS int) AS j, {r6_sql('greatest(t - knot, 0.0)')} AS value
  FROM times t JOIN knots k USING (series_id)""")
def hinge_features(spark, sf_dir):
    """The trend changes of the additive model on weekly values, a row per change."""
    rows = hinges(scaled_rows(panel(spark, sf_dir), KEY), "_t", "_knots")
    return rounded(rows.select(KEY, "ds", F.posexplode("hinges").alias("j", "value")), "value")


@query(f"""WITH {DAILY_SQL}
  SELECT series_id, ds, false AS is_future FROM daily UNION ALL
  SELECT series_id, cast(last + i * interval 1 day AS date), true FROM (
    SELECT series_id, max(ds) AS last FROM daily GROUP BY 1), generate_series(1, 7) t(i)""", name="future_frame")
def future_dates(spark, sf_dir):
    return future_frame(panel(spark, sf_dir, "D"), KEY, 7)


LABELS = [f"{name}|{offset}" for name in ("highest_value", "most_orders") for offset in (-1, 0, 1)]
SMALL_SQL = additive_steps("daily", 3, LABELS, 7, 600)


@query(f"""WITH RECURSIVE {DAILY_SQL}, {HOLIDAYS_SQL}, {TOUCHED_SQL}, {SMALL_SQL}
  SELECT series_id, ds, y, {r6_sql('yhat', 3)} AS yhat FROM additive""")
def forecast_additive_weekly(spark, sf_dir):
    """The additive model with three slope changes, the week and the holidays."""
    found = additive_forecast(panel(spark, sf_dir, "D"), KEY, seasonalities={"weekly": (7.0, 3)},
                              n_changepoints=3, holidays=holidays(spark, sf_dir))
    return rounded(found, "yhat", places=3).drop("status")


def _small_components(spark, sf_dir):
    return additive_components(panel(spark, sf_dir, "D"), KEY, seasonalities={"weekly": (7.0, 3)},
                               n_changepoints=3, holidays=holidays(spark, sf_dir))


@query(f"""WITH RECURSIVE {DAILY_SQL}, {HOLIDAYS_SQL}, {TOUCHED_SQL}, {SMALL_SQL}
  SELECT series_id, ds, y, is_test, {r6_sql('trend', 2)} AS trend, {r6_sql('weekly', 2)} AS weekly,
    {r6_sql('holidays', 2)} AS holidays, {r6_sql('trend + weekly + holidays', 2)} AS yhat
  FROM components""", name="additive_components")
def components(spark, sf_dir):
    """Fitted and forecast rows with their trend, week and holidays, of two calendars stacked."""
    found = _small_components(spark, sf_dir).drop("status")
    return rounded(found, "trend", "weekly", "holidays", "yhat", places=2)


HALF = 1.2815515655446004  # the normal quantile that 80 % in the middle end at


@query(f"""WITH RECURSIVE {DAILY_SQL}, {HOLIDAYS_SQL}, {TOUCHED_SQL}, {SMALL_SQL}, bands AS (
    SELECT *, trend + weekly + holidays AS yhat FROM components)
  SELECT series_id, ds, y, is_test, {r6_sql('yhat', 2)} AS yhat, {r6_sql(f'yhat - {HALF} * sd', 2)} AS yhat_lower,
    {r6_sql(f'yhat + {HALF} * sd', 2)} AS yhat_upper FROM bands""")
def additive_bands(spark, sf_dir):
    """Fitted and forecast rows between the values that four in five are expected to lie."""
    found = additive_components(panel(spark, sf_dir, "D"), KEY, seasonalities={"weekly": (7.0, 3)},
                                n_changepoints=3, holidays=holidays(spark, sf_dir), interval=0.8)
    found = found.select(KEY, "ds", "y", "is_test", "yhat", "yhat_lower", "yhat_upper")
    return rounded(found, "yhat", "yhat_lower", "yhat_upper", places=2)


@query(f"""WITH RECURSIVE {DAILY_SQL}, {HOLIDAYS_SQL}, {TOUCHED_SQL}, {SMALL_SQL}
  SELECT series_id, ds, unnest(['actual', 'trend', 'weekly', 'holidays', 'yhat']) AS panel,
    unnest([{r6_sql('y')}, {', '.join(r6_sql(c, 2) for c in (
      'trend', 'weekly', 'holidays', 'trend + weekly + holidays'))}]) AS value
  FROM components""")
def plot_additive(spark, sf_dir):
    """The additive model as a frame for a chart."""
    panels = {"actual": "y"} | {c: c for c in ("trend", "weekly", "holidays", "yhat")}
    frame = plot_frame(_small_components(spark, sf_dir), KEY, panels)
    value = F.when(F.col("panel") == "actual", r6("value")).otherwise(r6("value", 2))
    return frame.withColumn("value", value)


def _additive(spark, sf_dir):
    return additive_forecast(panel(spark, sf_dir, "D"), KEY, holidays=holidays(spark, sf_dir))


@query()
def forecast_additive(spark, sf_dir):
    """The last seven days of every priority; checked by brute force in the tests."""
    return _additive(spark, sf_dir)


@query()
def forecast_additive_us(spark, sf_dir):
    """The same with the holidays of the United States beside the table's own."""
    days = panel(spark, sf_dir, "D")
    calendar = stack(holidays(spark, sf_dir), country_holidays(days, "US"))
    return additive_forecast(days, KEY, holidays=calendar, interval=0.8)


@query()
def score_additive(spark, sf_dir):
    return score(_additive(spark, sf_dir), KEY)
