"""Personal data: fixed patterns, and boosted trees over wider candidates.

Generators with high recall propose spans, which may overlap: written-out e-mail addresses,
numbers of any grouping as card and as phone number, four dotted numbers. Features describe a
candidate's form (digits, groups, check sum, ranges) and what stands before and after it.
Candidates that a fixed pattern confirms are the positives, candidates that touch no confirmed
span the negatives. Trees are boosted on one half of the documents, and the other half sets, for
each kind, the score from which on 95 of 100 are positive. Only spans above it are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Boosted, calibrated, fit
from tidemark.llm.common import boxed, held, let, unboxed, written
from tidemark.llm.spans import masked, matches

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds. Possessive forms match what the plain ones match,
# and looking back spares the search inside a run that has failed from its start.
EMAIL = ("(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++")
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9]){12,}+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
PART = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
# The wider generators.
AT = "(?:@|\\x20?[(\\[]at[)\\]]\\x20?|\\x20at\\x20)"
DOT = "(?:\\.|\\x20?[(\\[]dot[)\\]]\\x20?|\\x20dot\\x20)"
WIDE_EMAIL = ("(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + AT
              + "[A-Za-z0-9-]++(?:" + DOT + "[A-Za-z0-9-]++)++")
WIDE_NUMBER = "(?<![0-9])[+(]?[0-9](?:[\\x20().:/-]{0,2}[0-9]){6,}+"
# Words that announce a kind, in any language of the corpus that uses them.
CUES = {
    "email": "mail|contact|write to",
    "ip": "\\bip\\b|host|server|address",
    "card": "card|visa|master|account|konto|carte",
    "phone": "phone|tel|call|fax|mobile|sms",
}


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the check sum holds."""
    def add(state: Column, d: Column) -> Column:
        twice = d.cast("int") * (1 + state["i"] % 2)
        return F.struct((state["i"] + 1).alias("i"),
                        (state["sum"] + F.when(twice > 9, twice - 9).otherwise(twice)).alias("sum"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda s: s["sum"] % 10 == 0)


def in_range(address: Column) -> Column:
    return F.forall(F.split(address, "\\."), lambda p: F.rlike(p, F.lit(PART)))


def span(s: Column, kind: str | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


SPAN = "struct<kind:string,start:int,end:int>"


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by kind as listed, then start."""
    value = {"value": lambda hit, gap, m: hit}
    found = {
        "email": (matches(text, EMAIL, value, likely=F.contains(text, F.lit("@"))), None),
        "ip": (matches(text, IP, value), in_range),
        "card": (matches(text, CARD, value), lambda v: let(
            digits_of(v), lambda d: F.length(d).between(13, 19) & luhn(d))),
        "phone": (matches(text, PHONE, value, likely=F.contains(text, F.lit("+"))),
                  lambda v: F.length(digits_of(v)).between(9, 15)),
    }
    kinds = []
    for kind in KINDS:
        spans, holds = found[kind]
        if holds is not None:
            spans = _holding(spans, holds)
        kinds.append(F.coalesce(_named(spans, kind), empty(SPAN)))
    return F.concat(*kinds)


def _holding(spans: Column, holds) -> Column:
    return F.filter(spans, lambda s: holds(s["value"]))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: span(s, kind))


def side(char: Column) -> Column:
    """0 nothing or space, 1 letter, 2 digit, 3 other."""
    return (F.when(F.rlike(char, F.lit("^\\s?$")), 0).when(F.rlike(char, F.lit("\\p{L}")), 1)
            .when(F.rlike(char, F.lit("[0-9]")), 2).otherwise(3))


FEATURES = ("digits", "groups", "check", "range", "even", "dotted", "before", "after", "cue")
CANDIDATE = f"struct<kind:string,start:int,end:int,{','.join(f'{f}:int' for f in FEATURES)}>"


def form(hit: Column) -> Column:
    """What a candidate's own characters say."""
    def read(d: Column) -> Column:
        groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
        return let(groups, lambda g: F.struct(
            F.least(F.length(d), F.lit(20)).alias("digits"),
            F.least(F.size(g), F.lit(6)).alias("groups"),
            F.when(d == "", False).otherwise(luhn(d)).cast("int").alias("check"),
            F.when(F.size(g) == 4, F.forall(g, lambda p: F.rlike(p, F.lit(PART))))
            .otherwise(False).cast("int").alias("range"),
            (F.size(F.array_distinct(F.transform(g, lambda p: F.length(p)))) <= 1).cast("int").alias("even"),
            F.rlike(hit, F.lit("\\.[A-Za-z]{2,}$|^[0-9]+(\\.[0-9]+){3}$")).cast("int").alias("dotted")))

    return let(digits_of(hit), read)


def candidates(text: Column) -> Column:
    """All proposed spans with their features; one place may be proposed as several kinds."""
    fields = {
        "form": lambda hit, gap, m: form(hit),
        "before": lambda hit, gap, m: side(F.right(gap, F.lit(1))),
        "after": lambda hit, gap, m: side(F.left(m["after"], F.lit(1))),
        "context": lambda hit, gap, m: F.lower(F.right(gap, F.lit(24))),
    }
    at = F.rlike(text, F.lit("@|[(\\[]at[)\\]]|\\x20dot\\x20"))
    mails = matches(text, WIDE_EMAIL, fields, likely=at)
    numbers = matches(text, WIDE_NUMBER, fields)
    proposals = []
    for kind, spans, apt in (
            ("email", mails, lambda f: F.lit(True)),
            ("ip", numbers, lambda f: (f["groups"] == 4) & (f["digits"] <= 12)),
            ("card", numbers, lambda f: f["digits"] >= 12),
            ("phone", numbers, lambda f: f["digits"] <= 16)):
        proposals.append(F.coalesce(_proposed(spans, kind, apt), empty(CANDIDATE)))
    return F.concat(*proposals)


def _proposed(spans: Column, kind: str, apt) -> Column:
    made = F.transform(F.filter(spans, lambda s: apt(s["form"])), lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        *[s["form"][f].cast("int").alias(f) for f in FEATURES[:6]],
        s["before"].cast("int").alias("before"), s["after"].cast("int").alias("after"),
        F.rlike(s["context"], F.lit(CUES[kind])).cast("int").alias("cue")))
    return made.cast(f"array<{CANDIDATE}>")


def touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def learned(rows: DataFrame, precision: float) -> dict[str, tuple[Boosted, float]]:
    """The trees and the least score of each kind. What comes to the driver is one row per
    combination of features, of which there are at most a fixed number."""
    counts = (
        rows.select(held(F.col("doc_id"), 2).alias("fold"), "_base", F.explode("_proposed").alias("c"))
        .withColumn("same", F.exists("_base", lambda b: (b["kind"] == F.col("c.kind"))
                                     & touches(b, F.col("c"))))
        .withColumn("touched", F.exists("_base", lambda b: touches(b, F.col("c"))))
        .where(F.col("same") | ~F.col("touched"))
        .groupBy("fold", "c.kind", *[f"c.{f}" for f in FEATURES])
        .agg(F.sum(F.col("same").cast("int")).alias("yes"),
             F.sum((~F.col("same")).cast("int")).alias("no")).collect()
    )
    found = {}
    for kind in KINDS:
        folds = [sorted((tuple(r[f] for f in FEATURES), r["yes"], r["no"])
                        for r in counts if r["kind"] == kind and r["fold"] == fold)
                 for fold in (0, 1)]
        model = fit(folds[0])
        found[kind] = model, calibrated(model, folds[1], precision)
    return found


def with_spans(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """Every column of ``docs``, with ``_base`` (kind, start, end) and ``_spans``: the base spans
    and the added ones, by kind, then start. An added span touches no base span, and of added
    spans that overlap the one with the highest score stays (then the longest, then the first).
    Null and empty texts have none; repeated rows get equal rows; without any candidate nothing
    is learned or added."""
    docs = docs.drop("_base", "_spans", "_proposed")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.withColumn("_base", base_spans(text))
                   .withColumn("_proposed", candidates(text)), "candidates")
    models = learned(rows, precision)

    def scored(c: Column) -> Column:
        score = F.lit(None).cast("double")
        for kind, (model, limit) in models.items():
            if limit < float("inf"):
                value = model.column([c[f] for f in FEATURES])
                score = F.when(c["kind"] == kind, F.when(value >= limit, value)).otherwise(score)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
                        score.alias("score"))

    free = F.filter("_proposed", lambda c: ~F.exists("_base", lambda b: touches(b, c)))
    chosen = F.filter(F.transform(free, scored), lambda c: c["score"].isNotNull())
    rank = lambda c: F.struct(c["score"], c["end"] - c["start"], -c["start"], c["kind"])
    single = let(chosen, lambda all_: F.filter(all_, lambda c: ~F.exists(
        all_, lambda o: touches(o, c) & (rank(o) > rank(c)))))
    place = F.array(*[F.lit(k) for k in KINDS])
    order = F.transform(F.concat("_base", F.transform(single, lambda s: span(s, s["kind"]))),
                        lambda s: F.struct(F.array_position(place, s["kind"]).alias("place"),
                                           s["start"].alias("start"), s["end"].alias("end"),
                                           s["kind"].alias("kind")))
    return rows.withColumn("_spans", F.transform(F.array_sort(order), lambda s: span(s, s["kind"]))
                           ).drop("_proposed")


def redacted(docs: DataFrame, mark: str = "[PRIVATE]", precision: float = 0.95) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``."""
    found = with_spans(boxed(docs, "doc_id", "text", apart=True), precision)
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"))))
    return found.select(*unboxed(
        docs.columns, doc_id=F.col("doc_id"), text=masked(F.col("text"), by_start, mark)))
