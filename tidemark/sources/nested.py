"""Nested rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import keys


def nest(df: DataFrame, by, layout: str | Iterable[str], struct_cols: Mapping[str, str] | Sequence[str],
         array_name: str, order: str) -> DataFrame:
    """One row per key and ``layout`` with an array of structs, sorted by the field ``order``.

    ``struct_cols`` names the fields (a mapping gives them new names).  ``layout`` is a column, or
    several, by which the array of a key is always laid out over rows and which are returned as part
    of the key, such as the year of an order: it bounds what one task holds, whatever the number
    of rows of a key.  An empty ``layout`` gives one array per key, for keys known to be small.
    """
    by = [*keys(by), *keys(layout)]
    fields = struct_cols if isinstance(struct_cols, Mapping) else {c: c for c in struct_cols}
    if order not in fields:
        raise ValueError("order must be one of the fields")
    lead = [order, *[f for f in fields if f != order]]
    item = F.struct(*[F.col(fields[f]).alias(f) for f in lead])
    shown = F.transform("_items", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return grouped.select(*by, shown.alias(array_name))


def first_element(df: DataFrame, array_col: str, field: str, out: str | None = None) -> DataFrame:
    """Add a field of the first struct of an array, NULL if the array is empty."""
    value: Column = F.get(F.col(array_col), F.lit(0))[field]
    return df.withColumn(out or field, value)


def first_of(df: DataFrame, by, fields: Mapping[str, str] | Sequence[str], order: str) -> DataFrame:
    """One row per key with the ``fields`` of its first row by the column ``order`` (NULL last), as
    the first element of its nested array would have them, but as a partial and a final minimum: no
    array is built, however many rows a key has."""
    by = keys(by)
    fields = fields if isinstance(fields, Mapping) else {c: c for c in fields}
    row = F.struct(F.col(order).isNull().alias("_none"), F.col(order).alias("_order"),
                   *[F.col(c).alias(f) for f, c in fields.items()])
    first = df.groupBy(*by).agg(F.min(row).alias("_first"))
    return first.select(*by, *[F.col(f"_first.{f}").alias(f) for f in fields])
