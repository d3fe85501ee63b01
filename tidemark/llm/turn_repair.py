"""Repair of conversations: their turns aligned to the grammar of who may speak when.

A sound conversation has the role initials ``(s?(ua)+)?``. For every length there is one such string
at most, and Wagner-Fischer alignment of the turns to that of each feasible length gives the
cheapest edits to reach it. The best cost so far is the incumbent: it limits the lengths still worth
trying, and the band of cells worth filling for each (Ukkonen). Of alignments that cost the same,
the audit (the initials of the edits, in order) that comes first in ASCII is taken.

Edits: ``K``eep 0, ``R``erole to user or assistant 1, ``D``elete 2, ``I``nsert an empty turn of user
or assistant 5. A blank or repeated turn must be deleted, a truncated one that is not adds 5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

VISIBLE = "[^\\x20\\x09-\\x0D]"
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
NEVER = 1 << 60
STRETCH = 48  # turns aligned at a time
ROLES = {"u": "user", "a": "assistant"}

# Places in the grammar: S before the system turn, T behind it, U before a user turn where the
# conversation may also end, A before an assistant turn.
SYMBOL = {"S": "s", "T": "u", "U": "u", "A": "a"}
AFTER = {"S": "T", "T": "A", "U": "A", "A": "U"}
ENDS = {"S": NEVER, "T": NEVER, "U": 0, "A": NEVER}


# ---------------------------------------------------------------------------------------------
# Alignment. A turn is one character: D if it must be deleted, else the initial of its role
# (o for any other), as a capital if it is truncated.


def target(place: str, length: int) -> tuple[str, str]:
    """The grammar's next ``length`` initials from a place on, and the place behind them."""
    symbols = []
    for _ in range(length):
        symbols.append(SYMBOL[place])
        place = AFTER[place]
    return "".join(symbols), place


def indels(surplus: int) -> int:
    """The least cost of edits that lengthen (or shorten) by so many turns."""
    return INSERT * surplus if surplus > 0 else -DELETE * surplus


def aligned(turns: str, symbols: str, after: int, most: int, last: bool):
    """Wagner-Fischer from the end: row i holds the cost of turning ``turns[i:]`` into
    ``symbols[j:]``, plus ``after``, for the j in its band. Cells through which every path costs
    more than ``most`` are outside. Turns are only inserted behind the ``last`` of all."""
    n, length = len(turns), len(symbols)
    forced = turns.count("D")
    surplus = length - (n - forced)
    spare = most - after - DELETE * forced - indels(surplus)
    if spare < 0:
        return None
    # Straying from the band between no surplus and all of it costs an insertion and a deletion.
    stray = spare // (INSERT + DELETE)
    low, high = min(0, surplus) - stray, max(0, surplus) + stray
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    free = n - forced  # turns before i that need not be deleted
    for i in range(n, -1, -1):
        if i < n and turns[i] != "D":
            free -= 1
        row, below = table[i], table[i + 1] if i < n else {}
        turn = turns[i] if i < n else ""
        for j in range(min(length, free + high), max(0, free + low) - 1, -1):
            if i == n:
                best = after if j == length else NEVER
            else:
                best = below.get(j, NEVER) + DELETE
                if turn != "D" and j < length and j + 1 in below:
                    pays = change(turn, symbols[j])
                    if pays is not None:
                        best = min(best, below[j + 1] + pays)
            if j < length and symbols[j] != "s" and (i < n or last):
                best = min(best, row.get(j + 1, NEVER) + INSERT)
            if best < NEVER:
                row[j] = best
    return table


def change(turn: str, symbol: str) -> int | None:
    """The cost of a turn that stays as one with the initial ``symbol``."""
    more = TRUNCATED if turn.isupper() else 0
    if turn.lower() == symbol:
        return more
    return None if symbol == "s" else REROLE + more


def traced(table, turns: str, symbols: str, last: bool) -> str:
    """The first in ASCII of the audits that cost the least: alignments with the same beginning
    stand in the same cell, so the smallest letter that leads on is always right."""
    audit, i, j = [], 0, 0
    n, length = len(turns), len(symbols)
    while i < n or j < length:
        cost = table[i][j]
        if i < n and table[i + 1].get(j, NEVER) + DELETE == cost:
            audit.append("D")
            i += 1
        elif (j < length and symbols[j] != "s" and (i < n or last)
              and table[i].get(j + 1, NEVER) + INSERT == cost):
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == symbols[j] else "R")
            i, j = i + 1, j + 1
    return "".join(audit)


def best_lengths(turns: str, place: str, ends: dict[str, int], last: bool, most: int = NEVER):
    """The least cost from a place on, if it is at most ``most``, and the lengths (with symbols
    and table) that reach it. ``ends`` has the cost of what follows by place. A first incumbent
    is guessed, and the spare cost in it doubled until some length stays within."""
    free = len(turns) - turns.count("D")
    base = DELETE * (len(turns) - free) + min(ends.values())
    worst = min(most, (len(turns) + 2) * (INSERT + TRUNCATED + REROLE) + max(
        c for c in ends.values() if c < NEVER))
    spare = INSERT + DELETE
    while base <= worst:
        incumbent, found = min(base + spare, worst), []
        # The nearest lengths first: a longer way costs at least its insertions or deletions.
        for surplus in sorted(range(-min(free, spare // DELETE), spare // INSERT + 1), key=indels):
            if base + indels(surplus) > incumbent:
                break
            symbols, behind = target(place, free + surplus)
            if ends[behind] >= NEVER:
                continue
            table = aligned(turns, symbols, ends[behind], incumbent, last)
            cost = table[0].get(0, NEVER) if table else NEVER
            if cost < incumbent:
                incumbent, found = cost, []
            if cost == incumbent:
                found.append((free + surplus, symbols, table, behind))
        if found or base + spare >= worst:
            return (incumbent, found) if found else (NEVER, [])
        spare *= 2
    return NEVER, []


def costs_from(turns: str, ends: dict[str, int], last: bool) -> dict[str, int]:
    """The least cost from every place on. A place is left out if another way to where it stands
    is cheaper for certain: before S, and but for one turn before T, everything was deleted, and
    U could be reached so as well; from A an insertion leads to U."""
    costs = {"U": best_lengths(turns, "U", ends, last)[0]}
    for place, more in (("A", INSERT), ("T", DELETE), ("S", 0)):
        costs[place] = best_lengths(turns, place, ends, last, costs["U"] + more)[0]
    return costs


def least_audit(turns: str, place: str, ends: dict[str, int], last: bool) -> tuple[str, str]:
    _, found = best_lengths(turns, place, ends, last)
    return min((traced(table, turns, symbols, last), behind)
               for _, symbols, table, behind in found)


def align(turns: str, stretch: int = STRETCH) -> tuple[int, str]:
    """The least cost and the audit of a conversation.

    A long one is cut into stretches. From the last to the first, each is aligned from every
    place of the grammar to every feasible length, with the costs of the next one behind it;
    then the audits are traced from the first to the last. Inserted turns stand before a turn of
    their stretch, so that no audit of a stretch begins another. Memory and time are linear.
    """
    parts = [turns[i:i + stretch] for i in range(0, len(turns), stretch)] or [""]
    ends = [ENDS]
    for k in range(len(parts) - 1, 0, -1):
        ends.append(costs_from(parts[k], ends[-1], k == len(parts) - 1))
    ends.reverse()
    results = []
    costs = costs_from(parts[0], ends[0], len(parts) == 1)
    least = min(costs["U"], costs["S"])
    for place in "US":
        if costs[place] > least:
            continue
        audit = []
        for k, part in enumerate(parts):
            some, place = least_audit(part, place, ends[k], k == len(parts) - 1)
            audit.append(some)
        results.append("".join(audit))
    return least, min(results)


@lru_cache(maxsize=100_000)
def align_short(turns: str) -> tuple[int, str]:
    """``align`` for conversations of one stretch, many of which look alike."""
    return align(turns)


# ---------------------------------------------------------------------------------------------
# Conversations


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` and ``gone`` of rows damaged by crc32(``conv_id:turn``) % 20: 0
    takes the row away (it stays, with ``gone`` true, to name its conversation), 1 empties the
    text, 2 removes its full stops, exclamation and question marks, 3 repeats the row, 4 makes the
    role user. A null counts as one space in the text, the role and the key."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"),
                        F.coalesce("text", blank).alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("_harm"))
    harm = F.col("_harm")
    return rows.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (harm == 0).alias("gone"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("_copy")).drop("_copy")


def _prepared(turns: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", blank).alias("role"),
                        F.coalesce("text", blank).alias("text"),
                        F.coalesce(gone, F.lit(False)).alias("gone"))


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(text, 256))


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text; with a column ``gone``, rows
    where it is true only name their conversation): ``conv_id``, ``gaps`` (turn numbers missing
    between the first and the last), ``blank``, ``duplicate``, ``truncated`` (turns by their first
    fault), ``illegal`` (neighbours whose role initials are none of su, ua, au), ``cost`` and
    ``audit`` of the cheapest repair.

    Turns stand in order of ``turn`` (nulls first), those with the same number in order of role
    and of the SHA-256 of their text. Null roles and texts count as one space; null is a
    conversation of its own. A conversation without rows has zeros and an empty audit, an empty
    table gives no rows. Other columns are not read. Texts are told apart by their SHA-256.

    Only marks of the texts are shuffled. A task meets the turns of a conversation as a sorted
    stream and holds one character of each.
    """
    body = F.col("text")
    end = F.regexp_extract(body, f"({VISIBLE})[\\x20\\x09-\\x0D]*\\z", 1)
    mark = (F.when(F.col("gone"), "x").when(end == "", "b")
            .when(end.isin(".", "!", "?"), "o").otherwise("t"))
    marked = _prepared(turns).select(
        "conv_id", "turn", "role", _digest().alias("_digest"), mark.alias("_mark"))
    marked = marked.repartition("conv_id")
    seen = F.row_number().over(
        Window.partitionBy("conv_id", "role", "_digest", F.col("_mark") == "x").orderBy("turn")) > 1
    stream = (
        marked.withColumn("_seen", seen)
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "_digest", "_seen")
        .select("conv_id", "turn", F.substring("role", 1, 1).alias("_initial"), "_mark", "_seen")
    )
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = StructType([stream.schema["conv_id"], *[StructField(c, LongType()) for c in names],
                         StructField("audit", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            id_type = batch.column(0).type
            for conv_id, turn, initial, mark, seen in zip(*columns):
                if state is None or conv_id != state.conv_id:
                    if state is not None:
                        done.append(state.result())
                    state = _Conversation(conv_id)
                state.add(turn, initial, mark, seen)
            yield as_batch(done, id_type)
        if state is not None:
            yield as_batch([state.result()], id_type)

    def as_batch(done, id_type):
        columns = list(zip(*done)) or [()] * 8
        kinds = [id_type, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return stream.mapInArrow(run, schema)


class _Conversation:
    """What is known of a conversation while its turns come by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes = bytearray()
        self.before = None  # the initial before
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial, mark, seen):
        if mark == "x":
            return
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        code = initial if initial in ("s", "u", "a") else "o"
        if mark == "b":
            self.blank, code = self.blank + 1, "D"
        elif seen:
            self.duplicate, code = self.duplicate + 1, "D"
        elif mark == "t":
            self.truncated, code = self.truncated + 1, code.upper()
        self.codes += code.encode()

    def result(self):
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        turns = self.codes.decode()
        cost, audit = (align_short if len(turns) <= STRETCH else align)(turns)
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
                cost, audit)


def _repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Per conversation its audit, then its turns in order: the stream that repairs read."""
    rows = _prepared(turns).where(~F.col("gone")).select(
        "conv_id", F.lit(True).alias("_turn"), "turn", "role", "text", _digest().alias("_digest"))
    none = F.lit(None)
    plans = found.select("conv_id", F.lit(False).alias("_turn"), none.cast("long").alias("turn"),
                         none.cast("string").alias("role"), F.col("audit").alias("text"),
                         none.cast("binary").alias("_digest"))
    return (
        rows.unionByName(plans).repartition("conv_id")
        .sortWithinPartitions("conv_id", "_turn", F.col("turn").asc_nulls_first(), "role", "_digest")
        .select("conv_id", "_turn", "role", "text")
    )


class _Repair:
    """The repaired turns of one conversation, as its turns come by."""

    def __init__(self, audit: str):
        self.audit = audit
        self.at = 0
        length = len(audit) - audit.count("D")
        self.place = "S" if length % 2 else "U"

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield ROLES[self.step()], ""
            self.at += 1

    def step(self) -> str:
        symbol, self.place = SYMBOL[self.place], AFTER[self.place]
        return symbol

    def turn(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            symbol = self.step()
            yield (role if edit == "K" else ROLES[symbol]), text


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after the repairs that ``audits`` found for them: ``conv_id, place`` (from 0),
    ``role, text``. Conversations that are repaired to nothing have no rows."""
    stream = _repaired(turns, found)
    schema = StructType([stream.schema["conv_id"], StructField("place", LongType()),
                         StructField("role", StringType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, current, place = None, None, 0
        for batch in batches:
            out = []
            for conv_id, is_turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if is_turn:
                    some = repair.turn(role, text)
                else:
                    out += [(current, place + k, *t) for k, t in
                            enumerate(repair.inserted() if repair else ())]
                    repair, current, place, some = _Repair(text), conv_id, 0, ()
                for role, text in some:
                    out.append((current, place, role, text))
                    place += 1
            yield as_batch(out, batch.column(0).type)
        if repair:
            rest = [(current, place + k, *t) for k, t in enumerate(repair.inserted())]
            yield as_batch(rest, batch.column(0).type)

    def as_batch(out, id_type):
        columns = list(zip(*out)) or [()] * 4
        kinds = [id_type, pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return stream.mapInArrow(run, schema)


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every column of ``found`` (from ``audits``) with ``repaired_sha256``: the SHA-256 of the repaired
    turns as lines ``role:text``. The lines are hashed as they come by, whatever their number."""
    kept = [c for c in found.columns if c != "conv_id"]
    stream = _repaired(turns, found)
    schema = StructType([stream.schema["conv_id"], StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = current = digest = None
        empty = True

        def put(some):
            nonlocal empty
            for role, text in some:
                if not empty:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
                empty = False

        for batch in batches:
            done = []
            for conv_id, is_turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if is_turn:
                    put(repair.turn(role, text))
                    continue
                if repair:
                    put(repair.inserted())
                    done.append((current, digest.hexdigest()))
                repair, current, digest, empty = _Repair(text), conv_id, hashlib.sha256(), True
            yield as_batch(done, batch.column(0).type)
        if repair:
            put(repair.inserted())
            yield as_batch([(current, digest.hexdigest())], batch.column(0).type)

    def as_batch(done, id_type):
        columns = list(zip(*done)) or [()] * 2
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], id_type), pa.array(columns[1], pa.string())], names=schema.names)

    hashes = stream.mapInArrow(run, schema).withColumnRenamed("conv_id", "_conv")
    joined = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", *kept, "repaired_sha256")
