"""Places of pattern matches in texts, in DataFrame functions alone.

Patterns are Java's. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm.common import let


def matches(text: Column, pattern: str, fields: dict[str, Callable[[Column, Column, Column], Column]],
            groups: Sequence[int] = (), likely: Column | None = None) -> Column:
    """The leftmost non-overlapping matches as an array of structs: start, end and ``fields``,
    made from the match, the text between it and the match before, and a struct with the text
    up to the next match (after) and the ``groups`` (g1, g2, ...).

    Splitting at the matches gives the text between them; the lengths add up to the places.
    Where ``likely`` is false the text is not searched; a text with no match is searched once.
    """
    hits = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")]
    hits += [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    pieces = F.split(text, pattern, -1)

    def walk(zipped: Column) -> Column:
        def item(begin: Column, m: Column) -> Column:
            return F.struct(
                begin.cast("int").alias("start"), (begin + F.length(m["hit"])).cast("int").alias("end"),
                *[make(m["hit"], m["gap"], m).alias(name) for name, make in fields.items()])

        # The piece after the last match has no match beside it.
        pairs = F.filter(zipped, lambda m: m["hit"].isNotNull())
        first = item(F.lit(0), F.element_at(zipped, 1))
        empty = F.filter(F.array(first), lambda _: F.lit(False))

        def merge(state: Column, m: Column) -> Column:
            return let(state["at"] + F.length(m["gap"]), lambda begin: F.struct(
                (begin + F.length(m["hit"])).alias("at"),
                F.concat(state["found"], F.array(item(begin, m))).alias("found")))

        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        return F.aggregate(pairs, start, merge, lambda s: s["found"])

    found = let(pieces, lambda gap: let(F.arrays_zip(
        *hits, gap.alias("gap"), F.slice(gap, 2, F.size(gap)).alias("after")), walk))
    sought = F.rlike(text, F.lit(pattern))
    return F.when(sought if likely is None else likely & sought, found)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span (sorted by start) replaced by ``mark``; spans that overlap or
    touch share one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def merge(state: Column, s: Column) -> Column:
        apart = (s["start"] > state["at"]) | (state["out"] == "")
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], F.substr(
                text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark)))
            .otherwise(state["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(
        spans, start, merge, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    ).otherwise(text)
