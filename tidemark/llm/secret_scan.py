"""Secret scans: fixed patterns, and a battery of randomness tests for other long tokens.

The encoding of a token is inferred from its characters. If it is a secret, its characters are
drawn evenly and independently from the encoding's alphabet. Three tests ask for that: chi-squared
on the counts of the characters, the number of runs above and below the middle of the alphabet,
and the serial correlation of neighbours. The smallest of the three p-values, times three, says how
far the token is from random.

Within a stratum of equal encoding and similar length, tokens are declared ordinary text by the
rule of Benjamini and Hochberg, so that the share of random tokens among them stays below ``q``
at every length; short tokens, on which the tests have little power, do not borrow from long
ones. Tokens that are not declared ordinary are secrets. All of it is column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, let, unboxed, written
from tidemark.llm.spans import masked, matches

# The patterns of the base kinds. Possessive forms match what the plain ones match.
ASSIGN = ("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
          "([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{12,}+"
HEX = "[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "random")
# Other tokens: long enough for tests to tell.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

# Alphabets of the encodings, the narrowest first; a token has the first that holds all of it.
ENCODINGS = (
    ("hex", "0123456789abcdef", "[0-9a-f]+"),
    ("hex", "0123456789ABCDEF", "[0-9A-F]+"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "[A-Z2-7]+=*"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", "[0-9a-z]+"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "[A-Za-z0-9]+"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
     "[A-Za-z0-9+/]+=*"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
     "[A-Za-z0-9_-]+=*"),
)
# Steps of the p-values' logarithm in which a stratum is counted.
STEPS = 400


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start, then kind as listed."""
    def plain(name: str) -> dict:
        return {"kind": lambda hit, gap, m: F.lit(name)}

    assign = F.filter(
        matches(text, ASSIGN, plain("assign") | {"value": lambda hit, gap, m: F.length(m["g1"])},
                groups=(1,),
                likely=F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))),
        lambda s: s["value"] >= 8)
    assign = F.transform(assign, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    access = matches(text, ACCESS, plain("access"), likely=F.contains(text, F.lit("AKIA")))
    hexes = matches(text, HEX, plain("hex"))
    return by_start(F.concat(*[or_none(s) for s in (assign, access, hexes)]))


def or_none(spans: Column) -> Column:
    return F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def by_start(spans: Column) -> Column:
    """Sorted by start, then by kind as listed."""
    place = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"),
        s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by a logistic approximation good to 2e-4."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def battery(token: Column) -> Column:
    """(encoding, size, p) of one token: p is null without an encoding, or where a letter or a
    digit is missing (words and numbers are in no encoding)."""
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, letters, form in reversed(ENCODINGS):
        fits = F.rlike(token, F.lit(f"^{form}$"))
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
    body = F.regexp_replace(token, "=+$", "")
    apt = F.rlike(token, F.lit("[0-9]")) & F.rlike(token, F.lit("[A-Za-z]"))

    def tests(t: Column) -> Column:
        chars, size = t["chars"], F.length(t["letters"]).cast("double")
        n = F.size(chars).cast("double")

        def from_places(x: Column) -> Column:
            counts = F.transform(F.array_distinct(x), lambda v: F.pow(
                n - F.size(F.array_remove(x, v)), F.lit(2)))
            squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
            chi = size / n * squares - n
            df = size - 1
            spread = 2 / (9 * df)
            z1 = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
            high = F.transform(x, lambda v: F.when(2 * v >= size, 1).otherwise(0))

            def runs(h: Column) -> Column:
                ones = F.aggregate(h, F.lit(0), lambda a, v: a + v).cast("double")
                turns = F.aggregate(F.sequence(F.lit(1), F.size(h) - 1), F.lit(1), lambda a, i: a + F.abs(
                    F.get(h, i) - F.get(h, i - 1))).cast("double")
                mean = 2 * ones * (n - ones) / n + 1
                var = (mean - 1) * (mean - 2) / (n - 1)
                return F.when(var > 0, F.abs(turns - mean) / F.sqrt(var)).otherwise(F.lit(38.0))

            def serial(m: Column) -> Column:
                total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v - m, F.lit(2)))
                lag = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda a, i: a + (
                    F.get(x, i) - m) * (F.get(x, i - 1) - m))
                return F.when(total > 0, F.abs(lag / total + 1 / n) * F.sqrt(n)).otherwise(F.lit(38.0))

            mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
            return F.struct(upper_tail(z1).alias("p1"), (2 * upper_tail(let(high, runs))).alias("p2"),
                            (2 * upper_tail(let(mean, serial))).alias("p3"))

        places = F.transform(chars, lambda c: (F.instr(t["letters"], c) - 1).cast("double"))
        return let(let(places, from_places), lambda p: F.least(
            F.lit(1.0), 3 * F.least(p["p1"], p["p2"], p["p3"])))

    prepared = F.struct(F.split(body, "").alias("chars"), alphabet.alias("letters"))
    return F.struct(encoding.alias("encoding"), F.length(body).alias("size"),
                    F.when(apt & encoding.isNotNull() & (F.length(body) >= 8),
                           let(prepared, tests)).alias("p"))


def step_of(p: Column) -> Column:
    """The step of a p-value, 0 for 1 and higher for smaller values; the last holds the rest."""
    return F.least(F.lit(STEPS), F.ceil(-10 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int"))


def stratum_of(encoding: Column, size: Column) -> Column:
    return F.concat_ws("/", encoding, F.floor(2 * F.log2(size)).cast("string"))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base``, its base spans, and ``_tokens``, the tested tokens that no base
    span touches: one pass over the texts, whose result is written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = matches(text, TOKEN, {
        "id": lambda hit, gap, m: F.xxhash64(hit), "test": lambda hit, gap, m: battery(hit)})
    return written(
        docs.withColumn("_base", base_spans(text)).withColumn("_found", tokens)
        .withColumn("_tokens", F.filter("_found", lambda t: t["test"]["p"].isNotNull() & ~F.exists(
            F.col("_base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
        .drop("_found"), "scanned")


def ordinary(rows: DataFrame, q: float) -> DataFrame:
    """(stratum, ordinary_from): tokens of the stratum whose step is at least this number are
    ordinary text. Distinct tokens are counted by step, so that copies weigh nothing; strata and
    steps are few whatever the input."""
    tokens = (
        rows.select(F.explode("_tokens").alias("t"))
        .select("t.id", stratum_of(F.col("t.test.encoding"), F.col("t.test.size")).alias("stratum"),
                step_of(F.col("t.test.p")).alias("step"))
        .groupBy("id").agg(F.min("stratum").alias("stratum"), F.min("step").alias("step"))
        .groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    )
    lower = Window.partitionBy("stratum").orderBy(F.desc("step"))
    every = Window.partitionBy("stratum")
    # The largest p-value of a step is 10 ** (-(step - 1) / 10).
    bound = F.pow(F.lit(10.0), -(F.col("step") - 1) / 10)
    passed = bound * F.sum("n").over(every) <= q * F.sum("n").over(lower)
    return (
        tokens.withColumn("passed", passed).where("passed")
        .groupBy("stratum").agg(F.min("step").alias("ordinary_from"))
    )


def with_spans(docs: DataFrame, q: float = 0.1) -> DataFrame:
    """Every column of ``docs``, with ``_base`` (start, end, kind) and ``_spans``: the base
    spans and the tokens that the tests leave as random, kind ``random``, by start. Null and
    empty texts have none; repeated rows get equal rows. Columns of ``docs`` that begin with an
    underscore and are named like the working columns are replaced."""
    rows = scanned(docs.drop("_base", "_spans", "_tokens", "_found", "_limits"))
    limits = ordinary(rows, q).agg(F.map_from_entries(F.collect_list(
        F.struct("stratum", "ordinary_from"))).alias("_limits"))  # one row
    extra = F.transform(F.filter("_tokens", lambda t: step_of(t["test"]["p"]) < F.coalesce(
        F.try_element_at(F.col("_limits"), stratum_of(t["test"]["encoding"], t["test"]["size"])),
        F.lit(STEPS + 1))),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"),
                           F.lit("random").alias("kind")))
    return (
        rows.crossJoin(F.broadcast(limits))
        .withColumn("_spans", by_start(F.concat("_base", or_none(extra))))
        .drop("_limits", "_tokens")
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]", q: float = 0.1) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; a column ``n_chars`` is
    counted anew where the text has changed."""
    found = with_spans(boxed(docs, "text", apart=True), q)
    changed = F.size("_spans") > 0
    text = masked(F.col("text"), F.col("_spans"), mark)
    found = found.withColumn("_new", text)
    instead = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        instead["n_chars"] = F.when(changed, F.length("_new").cast(kind)).otherwise(
            F.col("_row").getField("n_chars"))
    return found.select(*unboxed(docs.columns, **instead))
