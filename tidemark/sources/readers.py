"""Readers: delimited text, lines, JSON records and literal rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a daily price file.
PRICE_SCHEMA = (
    "`Date` date, `High` double, `Low` double, `Open` double, `Close` double, "
    "`Volume` bigint, `Adj Close` double"
)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
             header: bool = True, sep: str = ",", infer: bool = False) -> DataFrame:
    """A delimited file or folder.  With a ``schema`` the columns are typed at the
    scan; without one they are all strings, or guessed with ``infer``, which reads
    the data twice."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files, a row ``value`` per line."""
    return spark.read.text(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files with one JSON object per line."""
    return spark.read.schema(schema).json(path)


def parse_json_records(df: DataFrame, col: str, schema: str | T.StructType,
                       keep: Iterable[str] = ()) -> DataFrame:
    """Typed columns from a column of JSON text; a record that does not parse
    gives NULLs."""
    parsed = F.from_json(F.col(col), schema)
    return df.select(*keep, parsed.alias("_record")).select(*keep, "_record.*")


def literal(spark: SparkSession, rows: Iterable, schema: str | T.StructType) -> DataFrame:
    """A DataFrame from rows written in the program."""
    return spark.createDataFrame(list(rows), schema)
