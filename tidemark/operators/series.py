"""Building a panel and selecting rows from it."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import day_of, in_time, keys, number, whole_series


def to_series(
    df: DataFrame,
    by: str | Iterable[str] | None,
    ds: str,
    y: str,
    dtype: str = "double",
) -> DataFrame:
    """Project a table to key columns, a date ``ds`` and a value ``y``.

    ``dtype`` is the type of ``y``: ``double``, ``float``, or a decimal.
    """
    return df.select(*keys(by), day_of(df, ds).alias("ds"), number(F.col(y), dtype).alias("y"))


def date_range(df: DataFrame, ds: str, start: date | None = None, end: date | None = None,
               months: int | None = None) -> DataFrame:
    """Rows with ``start <= ds <= end`` (whole days).

    With ``months`` the start is that many months before ``end``.  The bare
    column is compared with constants, so the filter reaches the file scan.
    """
    kind = df.schema[ds].dataType
    if months is not None:
        if end is None or start is not None:
            raise ValueError("months needs an end and no start")
        first = F.add_months(F.lit(end), -months)
    else:
        first = None if start is None else F.lit(start)
    keep = F.lit(True)
    if first is not None:
        keep = keep & (F.col(ds) >= first.cast(kind))
    if end is not None:
        if isinstance(kind, T.DateType):
            keep = keep & (F.col(ds) <= F.lit(end))
        else:
            keep = keep & (F.col(ds) < F.date_add(F.lit(end), 1).cast(kind))
    return df.where(keep)


def drop_missing(df: DataFrame, cols: str | Iterable[str] = "y") -> DataFrame:
    return df.na.drop(subset=keys(cols))


def _ranked(df: DataFrame, by, order: list[str], last: bool) -> DataFrame:
    sort = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    spot = F.row_number().over(Window.partitionBy(*keys(by)).orderBy(*sort))
    return df.withColumn("_spot", spot)


def head(df: DataFrame, by, n: int, order: str | Iterable[str] = "ds") -> DataFrame:
    """First ``n`` rows of each series (of the whole table without ``by``).

    Spark keeps at most ``n`` rows per key on the map side, so a key that holds
    a large share of the table does not travel.
    """
    if not keys(by):
        return df.orderBy(*keys(order)).limit(n)
    return _ranked(df, by, keys(order), last=False).where(F.col("_spot") <= n).drop("_spot")


def tail(df: DataFrame, by, n: int, order: str | Iterable[str] = "ds") -> DataFrame:
    """Last ``n`` rows of each series (of the whole table without ``by``)."""
    if not keys(by):
        return df.orderBy(*[F.col(c).desc() for c in keys(order)]).limit(n)
    return _ranked(df, by, keys(order), last=True).where(F.col("_spot") <= n).drop("_spot")


def slice_end(df: DataFrame, by, a: int, b: int = 0, order: str | Iterable[str] = "ds") -> DataFrame:
    """Rows from the ``a``-th to before the ``b``-th counted from the end,
    as ``x[-a:-b]`` (``x[-a:]`` when ``b`` is 0)."""
    rows = _ranked(df, by, keys(order), last=True).where(F.col("_spot") <= a)
    return rows.where(F.col("_spot") > b).drop("_spot")


def split(df: DataFrame, by, frac: float | None = None, last: int | None = None,
          ds: str = "ds") -> DataFrame:
    """Add ``pos`` (1-based), ``n`` and ``is_test``.

    ``frac`` puts the first ``floor(n * frac)`` rows in training, the product
    taken in binary floating point (90 rows at 0.7 give 62).  ``last`` holds out
    that many final rows.
    """
    if (frac is None) == (last is None):
        raise ValueError("give exactly one of frac and last")
    placed = df.withColumns({
        "pos": F.row_number().over(in_time(by, ds)),
        "n": F.count(F.lit(1)).over(whole_series(by, ds)),
    })
    if frac is not None:
        train = F.floor(F.col("n") * F.lit(float(frac)))
    else:
        train = F.col("n") - F.lit(int(last))
    return placed.withColumn("is_test", F.col("pos") > train)
