import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from llm_rows import SF_DIR, rows
from pyspark.sql import functions as F

from tidemark.llm import turn_repair
from tidemark.llm.queries import QUERIES, TURNS_SQL

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def brute(turns):
    """The least (cost, audit) over all strings of edits that give a sound conversation, by
    trying every edit at every place: (turns left, initials so far as a grammar place)."""
    steps = {"start": {"s": "T", "u": "A"}, "T": {"u": "A"}, "A": {"a": "U"}, "U": {"u": "A"}}
    known = {}

    def go(i, place, row=0):
        key = i, place, row
        if key in known:
            return known[key]
        options = [(0, "")] if i == len(turns) and place in ("start", "U") else []
        if i < len(turns):
            code = turns[i]
            c, a = go(i + 1, place)
            options.append((c + 2, "D" + a))
            if code != "D":
                more = 5 if code.isupper() else 0
                for symbol, then in steps[place].items():
                    c, a = go(i + 1, then)
                    if code.lower() == symbol:
                        options.append((c + more, "K" + a))
                    if symbol != "s":
                        options.append((c + more + 1, "R" + a))
        if row < 3:  # more in one place never pays
            for symbol, then in steps[place].items():
                if symbol != "s":
                    c, a = go(i, then, row + 1)
                    options.append((c + 5, "I" + a))
        known[key] = min(options, default=(1 << 40, ""))
        return known[key]

    return go(0, "start")


def test_every_short_conversation():
    for n in range(6):
        for turns in itertools.product("suaoSUAOD" if n < 3 else "suAD" if n < 5 else "sua", repeat=n):
            turns = "".join(turns)
            assert turn_repair.align(turns) == brute(turns), turns


@pytest.mark.parametrize("stretch", [1, 2, 3, 5, 48])
def test_stretches(stretch):
    rng = random.Random(stretch)
    for n in (0, 1, 2, 5, 9, 17, 30):
        for k in range(12):
            some = rng.choice(["suaoSUAOD", "ua", "uaD", "uuaaUA", "sua", "oD", "SUA"])
            turns = "".join(rng.choice(some) for _ in range(n))
            assert turn_repair.align(turns, stretch) == brute(turns), turns


def test_very_long_conversation():
    rng = random.Random(3)
    turns = "s" + "".join("".join(x for x in "ua" if rng.random() > 0.05)
                          + ("D" if rng.random() < 0.1 else "") for _ in range(4000))
    cost, audit = turn_repair.align(turns)
    assert (cost, audit) == turn_repair.align(turns, 31)
    kept = sum(c != "I" for c in audit)
    assert kept == len(turns) and cost == sum({"I": 5, "D": 2, "R": 1, "K": 0}[c] for c in audit)


def repaired(conversation):
    """(gaps, blank, ..., audit, repaired lines) of rows (turn, role, text) by the contract."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                               hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults, codes = set(), [], []
    for _, role, text in rows:
        final = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        fault = ("blank" if not final else "duplicate" if (role, text) in seen
                 else "truncated" if final[1] not in ".!?" else "")
        seen.add((role, text))
        faults.append(fault)
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes.append("D" if fault in ("blank", "duplicate") else code.upper() if fault else code)
    numbers = sorted({r[0] for r in rows} - {None})
    gaps = numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = brute("".join(codes))
    length = len(audit) - audit.count("D")
    symbols = iter(("s" if length % 2 else "") + "ua" * length)
    lines, queue = [], iter(rows)
    for edit in audit:
        row = next(queue) if edit != "I" else (None, "", "")
        if edit != "D":
            symbol = next(symbols)
            role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[symbol]
            assert role[:1] == symbol
            lines.append((role, row[2]))
    assert GRAMMAR.match("".join(r[:1] for r, _ in lines))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost,
            audit, lines)


def harmed(table):
    out = {}
    for conv_id, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        harm = zlib.crc32(key.encode()) % 20
        rows = out.setdefault(conv_id, [])
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            rows += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def expected(table):
    found = []
    for conv_id, some in harmed(table).items():
        *numbers, lines = repaired(some)
        body = "\n".join(f"{r}:{t}" for r, t in lines)
        found.append((conv_id, *numbers, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(found, key=repr)


def odd_table():
    rng = random.Random(5)
    texts = ["Hello.", "Yes!", "no", "", " \t", None, "A long text. " * 3000, "Étion?", "Hello. ", "fin.\n"]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "u"]
    table = [(1, None, None, None), (2, 5, "user", "a."), (None, 1, "user", "x."), (None, 2, "assistant", "y."),
             (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 1, "assistant", "same."), (3, 9, "user", "same.")]
    for conv_id in range(10, 120):
        for turn in range(rng.randrange(1, 9)):
            turn = rng.choice([turn, turn, turn, None, turn + 3])
            table.append((conv_id, turn, rng.choice(roles), rng.choice(texts)))
    table += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 11 else "again.")
              for t in range(700)]
    rng.shuffle(table)
    return table


def audited(spark, df):
    turns = turn_repair.damaged(df)
    return rows(turn_repair.digests(turns, turn_repair.audits(turns)).select(*COLUMNS))


def by_sql(table):
    con = duckdb.connect()
    con.register("conversations", table)
    return sorted(con.execute(f"SELECT {','.join(COLUMNS)} FROM ({TURNS_SQL})").fetchall(), key=repr)


@pytest.mark.parametrize("parts", [1, 13])
def test_odd_rows(spark, parts):
    table = odd_table()
    df = spark.createDataFrame(table, SCHEMA).repartition(parts)
    clashing = df.withColumns({c: F.lit("kept") for c in "gone _mark _digest cost audit _turn place".split()})
    found = audited(spark, clashing)
    assert found == expected(table)
    assert found == by_sql(df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))


def test_empty_and_all_gone(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audited(spark, empty) == []
    lost = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, lost, "user", "a.")], SCHEMA)
    assert audited(spark, df) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_matches_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op12_turn_repair"](spark, SF_DIR)
    assert rows(found.select(*COLUMNS)) == expected(table)


def test_repaired_turns(spark):
    table = odd_table()
    df = spark.createDataFrame(table, SCHEMA)
    turns = turn_repair.damaged(df)
    got = turn_repair.repaired(turns, turn_repair.audits(turns)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for conv_id, some in harmed(table).items():
        lines = repaired(some)[-1]
        assert [x[1:] for x in sorted(by_id.pop(conv_id, []))] == lines
    assert not by_id
