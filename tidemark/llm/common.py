"""Helpers that several of the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.writers import scratch_path

WORD = "[^\\x20\\x09-\\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: it cuts the lineage, and
    what is read more than once is computed once. A lost executor takes nothing with it. The tables
    of a pipeline stay until the session ends, so they are packed more tightly than by default."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(a: Column, b: Column) -> Column:
    """Equality that also holds between nulls."""
    return a.eqNullSafe(b)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has (case aside)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def boxed(df: DataFrame, *names: str, apart: bool = False) -> DataFrame:
    """All columns of ``df`` in one struct ``_row``, beside copies of the named ones: whatever the
    others are called, working columns cannot clash with them. With ``apart`` the named ones are
    left out of the struct."""
    inside = [df[c] for c in df.columns if not (apart and c in names)]
    return df.select(F.struct(*(inside or [F.lit(None).alias("none")])).alias("_row"),
                     *[df[c] for c in names])


def unboxed(columns: list[str], **instead: Column) -> list[Column]:
    """The columns of the struct that ``boxed`` made, those in ``instead`` replaced."""
    return [instead.get(c, F.col("_row").getField(c)).alias(c) for c in columns]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. A text of ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it, also inside
    functions that run once per array element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_small(df: DataFrame, most: int = 32 << 20) -> bool:
    """True if all strings and numbers of a written table together take at most ``most``
    bytes, so that it may be sent to every task."""
    size = F.lit(16)
    for c, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind == "string"
                       else F.lit(16))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow column."""
    for value in pc.cast(column, pa.large_binary()):
        yield value.as_py()


def learned_on(doc_id: Column, modulus: int, kept_out: int) -> Column:
    """True where a document is for learning: crc32 of its id as text, modulo. A null id
    counts as the empty text."""
    return held(doc_id, modulus) != kept_out


def held(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shuffle_width(df: DataFrame) -> int:
    """The number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix64(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over their whole range (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
