"""Public holidays against the calendars of the standard library."""

import calendar
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators.calendars import COUNTRIES, easter


def easter_sunday(year):
    """By the moon and the tables of the Gregorian calendar (Meeus, Jones and Butcher)."""
    a, b, c = year % 19, year // 100, year % 100
    d, e, g = b // 4, b % 4, (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    m = (a + 11 * h) // 319
    r = (2 * e + 2 * (c // 4) - c % 4 - h + m + 32) % 7
    month = (h - m + r + 90) // 25
    return date(year, month, (h - m + r + month + 19) % 32)


def test_easter_of_a_thousand_years(spark):
    rows = spark.range(1583, 2600).select(F.col("id").cast("int").alias("year"))
    for r in rows.select("year", easter(F.col("year")).alias("ds")).collect():
        assert r.ds == easter_sunday(r.year)


def by_hand(rule, year):
    if not rule.since <= year <= rule.until:
        return None
    if rule.month is None:
        return easter_sunday(year) + timedelta(days=rule.day)
    if rule.weekday is None:
        return date(year, rule.month, rule.day)
    place = "MON TUE WED THU FRI SAT SUN".split().index(rule.weekday)
    days = [week[place] for week in calendar.monthcalendar(year, rule.month) if week[place]]
    return date(year, rule.month, days[rule.nth - 1 if rule.nth > 0 else rule.nth])


@pytest.mark.parametrize("country", sorted(COUNTRIES))
def test_rules(spark, country):
    years = spark.range(1890, 2060).select(F.col("id").cast("int").alias("year"))
    got = {(r.holiday, r.ds) for r in tm.holiday_calendar(years, country).collect()}
    want = set()
    for year in range(1890, 2060):
        for rule in COUNTRIES[country]:
            ds = by_hand(rule, year)
            if ds:
                want.add((rule.holiday, ds))
                if rule.shifted and ds.weekday() >= 5:
                    want.add((f"{rule.holiday} (observed)", ds + timedelta(days=1 if ds.weekday() == 6 else -1)))
    assert got == want


def test_own_rules_and_years_of_a_table(spark, panel):
    mine = [tm.Rule("last Friday", 11, weekday="FRI", nth=-1, since=2021), tm.Rule("leap", 2, 29)]
    years = spark.createDataFrame([(2020,), (2021,)], "year int")
    got = {(r.holiday, r.ds) for r in tm.holiday_calendar(years, mine).collect()}
    assert got == {("last Friday", date(2021, 11, 26)), ("leap", date(2020, 2, 29))}
    days = tm.country_holidays(panel, "US", ahead=2, lower_window=-1)
    span = panel.agg(F.min(F.year("ds")), F.max(F.year("ds"))).first()
    ours = {r.y for r in days.where("holiday = 'Labor Day'").select(F.year("ds").alias("y")).collect()}
    assert ours == set(range(span[0], span[1] + 3))
    assert tm.holiday_days(days).count() == 2 * days.count()
    assert tm.country_holidays(panel.limit(0), "US").count() == 0
    with pytest.raises(ValueError):
        tm.country_holidays(panel, "Atlantis")
