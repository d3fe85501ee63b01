"""Public holidays of countries by rule, for any span of years, as columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One holiday a year: on ``day`` of ``month``; or, with ``weekday`` (MON to SUN), on the
    ``nth`` of these in the month, counted from its end if negative; or, without a month,
    ``day`` days after Easter Sunday. Kept from the year ``since`` to the year ``until``; with
    ``shifted``, a day at the weekend is also observed on the nearest day of the week."""

    holiday: str
    month: int | None = None
    day: int | None = None
    weekday: str | None = None
    nth: int = 1
    since: int = 0
    until: int = 9999
    shifted: bool = False


# The public holidays that hold in all of a country.
COUNTRIES = {
    "US": (
        Rule("New Year's Day", 1, 1, shifted=True),
        Rule("Martin Luther King Jr. Day", 1, weekday="MON", nth=3, since=1986),
        Rule("Washington's Birthday", 2, weekday="MON", nth=3, since=1971),
        Rule("Memorial Day", 5, weekday="MON", nth=-1, since=1971),
        Rule("Juneteenth", 6, 19, since=2021, shifted=True),
        Rule("Independence Day", 7, 4, shifted=True),
        Rule("Labor Day", 9, weekday="MON", nth=1, since=1894),
        Rule("Columbus Day", 10, weekday="MON", nth=2, since=1971),
        Rule("Veterans Day", 11, 11, since=1978, shifted=True),
        Rule("Thanksgiving", 11, weekday="THU", nth=4, since=1942),
        Rule("Christmas Day", 12, 25, shifted=True),
    ),
    "DE": (
        Rule("Neujahr", 1, 1),
        Rule("Karfreitag", day=-2),
        Rule("Ostermontag", day=1),
        Rule("Tag der Arbeit", 5, 1),
        Rule("Christi Himmelfahrt", day=39),
        Rule("Pfingstmontag", day=50),
        Rule("Tag der Deutschen Einheit", 10, 3, since=1990),
        Rule("Erster Weihnachtstag", 12, 25),
        Rule("Zweiter Weihnachtstag", 12, 26),
    ),
}


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar: the Sunday after the full moon of spring, by the
    moon's place in its cycle of 19 years and the century's corrections to it."""
    golden, century = year % 19, F.floor(year / 100)
    skipped = century - F.floor(century / 4)
    moon = (19 * golden + skipped - F.floor((8 * century + 13) / 25) + 15) % 30
    # The two latest full moons are taken a day early, so that none falls together.
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.next_day(full, "SUN")


def _on(rule: Rule, year: Column) -> Column:
    if rule.month is None:
        return F.date_add(easter(year), rule.day)
    first = F.make_date(year, F.lit(rule.month), F.lit(1))
    if rule.weekday is None:
        return F.when(F.dayofmonth(F.last_day(first)) >= rule.day, F.date_add(first, rule.day - 1))
    if rule.nth > 0:
        return F.date_add(F.next_day(F.date_sub(first, 1), rule.weekday), 7 * (rule.nth - 1))
    return F.date_add(F.next_day(F.date_sub(F.last_day(first), 7), rule.weekday), 7 * (rule.nth + 1))


def holiday_calendar(years: DataFrame, rules: str | Iterable[Rule], lower_window: int = 0,
                     upper_window: int = 0) -> DataFrame:
    """The holidays of each ``year`` (a column of ``years``, each once): ``holiday``, ``ds``,
    ``lower_window``, ``upper_window``, as the additive model takes them. ``rules`` is the name
    of one of ``COUNTRIES`` or a list of rules. An observed day has ``(observed)`` behind its name;
    it may lie in the year before."""
    if isinstance(rules, str):
        if rules not in COUNTRIES:
            raise ValueError(f"no rules for {rules}; there are {', '.join(sorted(COUNTRIES))}")
        rules = COUNTRIES[rules]
    year = F.col("year")
    cells = []
    for rule in rules:
        kept = (year >= rule.since) & (year <= rule.until)
        cells.append(F.when(kept, F.struct(F.lit(rule.holiday).alias("holiday"),
                                           _on(rule, year).alias("ds"), F.lit(rule.shifted).alias("shifted"))))
    days = years.select(F.inline(F.array(*cells))).where(F.col("ds").isNotNull())
    weekday = F.dayofweek("ds")  # 1 is Sunday
    moved = F.when(weekday == 1, F.date_add("ds", 1)).when(weekday == 7, F.date_sub("ds", 1))
    seen = F.array(
        F.struct(F.col("holiday"), F.col("ds")),
        F.when(F.col("shifted"), F.struct(F.concat("holiday", F.lit(" (observed)")).alias("holiday"),
                                          moved.alias("ds"))))
    return days.select(F.inline(seen)).where(F.col("ds").isNotNull()).select(
        "holiday", "ds", F.lit(lower_window).alias("lower_window"), F.lit(upper_window).alias("upper_window"))


def years_of(df: DataFrame, ds: str = "ds", ahead: int = 0) -> DataFrame:
    """Every year from the first to the last of ``ds``, and ``ahead`` more: ``year``."""
    ends = df.agg(F.min(F.year(ds)).alias("a"), F.max(F.year(ds)).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", F.col("b") + ahead)).alias("year"))


def country_holidays(df: DataFrame, country: str, ds: str = "ds", ahead: int = 1,
                     lower_window: int = 0, upper_window: int = 0) -> DataFrame:
    """The public holidays of ``country`` in the years of ``df`` and ``ahead`` years after them."""
    return holiday_calendar(years_of(df, ds, ahead), country, lower_window, upper_window)
