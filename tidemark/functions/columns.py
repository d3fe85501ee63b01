"""Column helpers used across the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_BEFORE = (Window.unboundedPreceding, -1)
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def keys(by: str | Iterable[str] | None) -> list[str]:
    """The key columns as a list; accepts one name, several, or none."""
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def in_time(by: str | Iterable[str] | None, ds: str = "ds") -> WindowSpec:
    """The one window every time-series operator uses, so that a chain of them
    needs a single shuffle and a single sort."""
    return Window.partitionBy(*keys(by)).orderBy(ds)


def whole_series(by: str | Iterable[str] | None, ds: str = "ds") -> WindowSpec:
    """All rows of the series, in time order: this shares the sort of ``in_time``,
    and sums do not depend on the order in which rows arrive."""
    return in_time(by, ds).rowsBetween(*WHOLE)


def same_key(left: str, right: str, names: Iterable[str]) -> Column:
    """Equality of the named columns of two aliased tables; NULL equals NULL."""
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL, not an error, when the divisor is zero."""
    return F.try_divide(top, bottom)


def number(column: Column, dtype: str = "double") -> Column:
    """Cast to a numeric type; NaN becomes NULL, because Spark aggregates skip
    NULL but not NaN."""
    cast = column.cast(dtype)
    if dtype in ("double", "float"):
        return F.when(~F.isnan(cast), cast)
    return cast


def units(column: Column, places: int) -> Column:
    """A value with ``places`` decimals as a whole number of its smallest unit.
    Sums of these are exact whatever the order of the rows, and raise an error
    should they pass the range of a long."""
    return F.rint(column * F.lit(10.0**places)).cast("bigint")


def parse_date(column: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date; text that does not parse becomes NULL."""
    return F.to_date(F.try_to_timestamp(column, F.lit(fmt)))


def week_end(day: Column) -> Column:
    """The Sunday on or after a day: the label of its weekly bucket."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def day_of(df: DataFrame, ds: str) -> Column:
    """A day-grained version of ``ds``, whatever its type."""
    kind = df.schema[ds].dataType
    if isinstance(kind, T.DateType):
        return F.col(ds)
    if isinstance(kind, T.StringType):
        return parse_date(F.col(ds))
    return F.to_date(ds)
