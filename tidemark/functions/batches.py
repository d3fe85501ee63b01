"""Helpers for functions over batches of rows of several series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def keyed_schema(df: DataFrame, by: list[str], tail: str) -> T.StructType:
    """The key columns of ``df`` followed by the columns of a DDL string."""
    return T.StructType([df.schema[c] for c in by] + T.StructType.fromDDL(tail).fields)


def by_series(batch: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each series in a batch."""
    if batch.empty:
        return
    if by:
        yield from batch.groupby(by, dropna=False, sort=False)
    else:
        yield (), batch
