"""URL filters: rules, and for the rest a classifier on the words of host and path.

Host labels such as ``cheappills`` run words together. A unigram model of words, counted over
the parts of all URLs, splits them by Viterbi; multinomial naive Bayes, learned from the URLs on
which a rule decides, then scores the words of host and path.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, lower_ascii, unboxed, written

# Longer substrings are no words of the model; a label is split whole all the same.
LONGEST = 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(_after(url), "^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule that fits, as a struct of rule and verdict; null where none does. ``rules``
    are (verdict, host, path prefix). A rule fits its host and all subdomains; the longest
    wins, of equally long ones the first by code point."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in reversed(ordered):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def parts_of(value: Column) -> Column:
    """The runs of letters, digits and non-ASCII characters, in lower case."""
    return F.filter(F.split(lower_ascii(value), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"),
                    lambda p: p != "")


def segmented(parts: DataFrame, words: DataFrame) -> DataFrame:
    """Split each distinct ``part`` of host names into words: (part, words).

    ``words`` is (word, n), the unigram counts. Every substring of up to ``LONGEST`` characters
    meets its count in a join, so the model is never copied to the tasks whole; Viterbi then
    runs over the substrings of one part at a time, which its length bounds. A substring
    without a count costs as much as its length in unseen characters. Of splits that score
    alike, the one with the longer last word is taken.
    """
    total = words.agg(F.sum("n").alias("_total"))
    spans = (
        parts.select("part").distinct()
        .withColumn("_from", F.explode(F.sequence(F.lit(1), F.length("part"))))
        .withColumn("_len", F.explode(F.sequence(
            F.lit(1), F.least(F.lit(LONGEST), F.length("part") - F.col("_from") + 1))))
        .withColumn("word", F.substr("part", F.col("_from"), F.col("_len")))
    )
    known = (
        spans.join(words.select("word", "n"), "word")
        .crossJoin(F.broadcast(total))  # one row
        .select("part", (F.col("_from") - 1).alias("start"), F.col("_len").alias("length"),
                F.ln(F.col("n") / F.col("_total")).alias("score"))
    )
    # Parts without any known substring keep one row, so that they are split as well.
    rows = parts.select("part").distinct().join(known, "part", "left")
    return rows.groupBy("part").applyInPandas(_viterbi, "part string, words array<string>")


def _viterbi(rows: pd.DataFrame) -> pd.DataFrame:
    part = rows["part"].iloc[0]
    scores = {(int(s), int(n)): float(v) for s, n, v in
              zip(rows["start"], rows["length"], rows["score"]) if not math.isnan(v)}
    unseen = math.log(1e-6)
    best, back = [0.0] + [-math.inf] * len(part), [0] * (len(part) + 1)
    for end in range(1, len(part) + 1):
        for length in range(1, min(LONGEST, end) + 1):
            start = end - length
            score = best[start] + scores.get((start, length), unseen * (1 + length))
            if score >= best[end]:
                best[end], back[end] = score, start
    cuts, end = [], len(part)
    while end:
        cuts.append(part[back[end]:end])
        end = back[end]
    return pd.DataFrame({"part": [part], "words": [cuts[::-1]]})


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]],
          blocked: str = "block", allowed: str = "allow") -> DataFrame:
    """Every column of ``pages``, with ``host``, ``path``, ``rule`` (null if none fits),
    ``verdict`` and ``log_odds`` (of blocked against allowed, null where a rule decides).

    A null URL, or one without ``://``, has an empty host and path, no words, and gets the
    verdict that more rule decisions have; so does everything if no rule decides anything
    (a tie allows). Repeated rows are judged alike, and each is counted once in learning.
    Columns of these names in ``pages`` are replaced.
    """
    columns = [c for c in pages.columns
               if c.lower() not in ("host", "path", "rule", "verdict", "log_odds")]
    host, path, fit = "_host", "_path", "_fit"
    base = (
        boxed(pages, "url").withColumn(host, F.coalesce(host_of(F.col("url")), F.lit("")))
        .withColumn(path, F.coalesce(path_of(F.col("url")), F.lit("")))
        .withColumn(fit, rule_of(F.col(host), F.col(path), rules))
    )
    # One row per distinct host, path and decision: what follows grows with those.
    kinds = written(
        base.groupBy(host, path, F.col(f"{fit}.verdict").alias("known"))
        .agg(F.count(F.lit(1)).alias("pages")), "urls")
    sides = kinds.select(
        host, path, "known", "pages", parts_of(F.col(host)).alias("host_parts"),
        parts_of(F.col(path)).alias("path_parts"))
    host_parts = sides.select("pages", F.explode("host_parts").alias("part"))
    path_parts = sides.select("pages", F.explode("path_parts").alias("part"))
    words = (host_parts.union(path_parts).groupBy(F.col("part").alias("word"))
             .agg(F.sum("pages").alias("n")))
    # A part is made of shorter words only where these are more likely together; whole parts
    # that occur once or never again are thereby split into frequent ones.
    splits = written(segmented(host_parts, words), "segments")
    terms = written(
        sides.select(host, path, "known", "pages", F.explode("host_parts").alias("part"))
        .join(splits, "part")
        .select(host, path, "known", "pages", F.explode("words").alias("word"))
        .withColumn("word", F.concat(F.lit("h:"), "word"))
        .unionByName(sides.select(host, path, "known", "pages",
                                  F.explode("path_parts").alias("word"))
                     .withColumn("word", F.concat(F.lit("p:"), "word"))), "terms")
    blocks, allows = (F.sum(F.when(F.col("known") == v, F.col("pages")).otherwise(0))
                      for v in (blocked, allowed))
    counts = terms.groupBy("word").agg(blocks.alias("b"), allows.alias("a"))
    sums = counts.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("tb"),
                      F.coalesce(F.sum("a"), F.lit(0)).alias("ta"),
                      F.count(F.lit(1)).alias("v"))
    prior = kinds.agg(F.coalesce(blocks, F.lit(0)).alias("pb"),
                      F.coalesce(allows, F.lit(0)).alias("pa"))
    weight = F.ln((F.col("b") + 1) / (F.col("tb") + F.col("v"))) - F.ln(
        (F.col("a") + 1) / (F.col("ta") + F.col("v")))
    weights = counts.crossJoin(F.broadcast(sums)).select("word", weight.alias("weight"))
    scored = (
        terms.where("known is null").join(weights, "word")
        .groupBy(host, path).agg(F.sum("weight").alias("sum"))
    )
    h, p = F.col("_h"), F.col("_p")
    scored = scored.select(F.col(host).alias("_h"), F.col(path).alias("_p"), "sum")
    bias = F.ln((F.col("pb") + 1) / (F.col("pa") + 1))
    odds = F.coalesce(F.col("sum"), F.lit(0.0)) + bias
    judged = (
        base.join(scored, (F.col(host) == h) & (F.col(path) == p), "left")
        .crossJoin(F.broadcast(prior))  # one row
        .withColumn("_odds", F.when(F.col(fit).isNull(), odds))
        .select(*unboxed(columns), F.col(host).alias("host"), F.col(path).alias("path"),
                F.col(f"{fit}.rule").alias("rule"),
                F.coalesce(F.col(f"{fit}.verdict"),
                           F.when(F.col("_odds") > 0, blocked).otherwise(allowed))
                .alias("verdict"), F.col("_odds").alias("log_odds"))
    )
    return judged


