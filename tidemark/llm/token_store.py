"""Token ids of documents in a binary store: blocks of ids turned into planes, each packed.

The ids of all documents stand one after another, in ascending order of doc_id, cut into shards
(one per task that wrote) and these into chunks of a fixed number of ids. A chunk is transposed:
plane b holds bit b (or byte b) of all its ids, so that the high planes, which hardly change, pack
to almost nothing. A store is a folder of two Parquet tables, which Spark's writers commit task by
task:

``kind=chunk``: ``shard, at`` (number of the first id in the shard), ``n`` (ids), ``sizes`` (packed
bytes of each plane; together with ``shard`` and ``at`` the chunk index) and ``packed``, the planes
one after another, each a frame of zstandard, an empty one for a plane of zeros.

``kind=document``: ``shard, at, n, doc_id``: where each document's ids begin, and how many they are.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STORE = ("kind string, shard int, at long, n long, doc_id {doc_id}, sizes array<int>, packed binary")
PART = 16 << 20  # bytes of text handled at a time
MOST_KNOWN = 600_000  # words whose ids a Python worker remembers

# White space as Python's \s has it, which includes all that the pre-tokenizer knows.
SPACE = ("\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
         "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}")
LOOSE_SPACE = f" (?:[{SPACE}]|$)"
PIECE = re.compile(r"(?= \S)")
TAIL = ".,;:!?()[]{}\"'\n"
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------------------------------------
# Planes


def _turned(words: np.ndarray) -> np.ndarray:
    """Each 64-bit word as a square of 8 x 8 bits, transposed: by halves of 1, 2 and 4 bits."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0xF0F0F0F0)):
        moved = (words ^ (words >> np.uint64(shift))) & np.uint64(mask)
        words = words ^ moved ^ (moved << np.uint64(shift))
    return words


def bits_apart(planes: np.ndarray) -> np.ndarray:
    """Byte planes (k, n) as bit planes (8 k, n / 8 rounded up): row 8 k + b holds bit b."""
    k, n = planes.shape
    even = np.zeros((k, -(-n // 8) * 8), np.uint8)
    even[:, :n] = planes
    turned = _turned(even.view("<u8")).view(np.uint8).reshape(k, -1, 8)
    return np.ascontiguousarray(turned.transpose(0, 2, 1)).reshape(8 * k, -1)


def bits_together(planes: np.ndarray) -> np.ndarray:
    """The byte planes that ``bits_apart`` took apart, with up to seven zeros behind each."""
    k = len(planes) // 8
    even = np.ascontiguousarray(planes.reshape(k, 8, -1).transpose(0, 2, 1))
    return _turned(even.reshape(k, -1).view("<u8")).view(np.uint8)


def to_planes(ids: np.ndarray, unit: str = "bit", level: int = 1) -> tuple[list[int], bytes]:
    """The packed planes of 32-bit ids and their sizes: 32 planes of bits or 4 of bytes, lowest
    first. Planes above the highest one in use are left out."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    used = -(-int(ids.max()).bit_length() // 8) if len(ids) else 0
    planes = np.ascontiguousarray(raw[:, :used].T)
    if unit == "bit" and used:
        planes = bits_apart(planes)
    pack = zstandard.ZstdCompressor(level=level).compress
    packed = [pack(p.tobytes()) if p.any() else b"" for p in planes]
    return [len(p) for p in packed], b"".join(packed)


def from_planes(n: int, sizes: list[int], packed: bytes, unit: str = "bit") -> np.ndarray:
    """The ids that ``to_planes`` packed."""
    unpack = zstandard.ZstdDecompressor().decompress
    width = (n + 7) // 8 if unit == "bit" else n
    planes = np.zeros((len(sizes), width), np.uint8)
    begin = 0
    for plane, size in zip(planes, sizes):
        if size:
            plane[:] = np.frombuffer(unpack(packed[begin:begin + size], max_output_size=width),
                                     np.uint8)
        begin += size
    if unit == "bit" and sizes:
        planes = bits_together(planes)[:, :n]
    raw = np.zeros((n, 4), np.uint8)
    for i, plane in enumerate(planes):
        raw[:, i] = plane
    return raw.reshape(-1).view("<u4")


# ---------------------------------------------------------------------------------------------
# Ids


class Encoder:
    """Ids of many texts by a tokenizer of the ``tokenizers`` library.

    Byte-level tokenizers that split by their usual pattern never join what stands before a space
    with a space and the visible character after it. Their texts are cut there, each different
    piece is encoded once, and the ids are laid side by side: the same ids as of the whole text.
    Other tokenizers get the whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in plan.get("added_tokens") or []]
        split, model = plan.get("pre_tokenizer") or {}, plan["model"]
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and not plan.get("normalizer")
            and not plan.get("truncation") and not plan.get("padding")
            and model.get("type") == "BPE" and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and all(not t.get("lstrip") and not t.get("rstrip") and " " not in t["content"]
                    for t in plan.get("added_tokens") or []))
        # Byte-level tokens are spelt with one character per byte.
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def spaced(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that each stand behind a space and begin with a visible character:
        they are encoded as one text, whose ids are dealt out by the bytes that they stand for."""
        if not pieces:
            return []
        (raw,) = self.whole([" " + " ".join(pieces)])
        ends = np.cumsum(self.bytes_of[np.frombuffer(raw, "<u4")])
        sizes = pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy()
        last = np.searchsorted(ends, np.cumsum(sizes + 1))
        cuts = [0, *(4 * (last + 1)).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def learned(self, pieces: list[str]) -> list[bytes]:
        """The same, from memory where a piece was met before. Punctuation behind a letter makes
        tokens of its own, so a word is encoded once whatever follows it."""
        found = list(map(self.known.get, pieces))
        new = [i for i, raw in enumerate(found) if raw is None]
        words, tails = [], []
        for i in new:
            piece = pieces[i]
            word = piece.rstrip(TAIL)
            if not word or word[-1] not in LETTERS:
                word = piece
            words.append(word)
            tails.append(piece[len(word):])
        fresh = {w: None for w in words if w not in self.known}
        some = list(fresh)
        for i in range(0, len(some), 500):
            part = some[i:i + 500]
            fresh.update(zip(part, self.spaced(part)))
        after = list({t for t in tails if t not in self.tails})
        behind = self.tails | dict(zip(after, self.whole(after)))
        for i, word, tail in zip(new, words, tails):
            found[i] = (fresh.get(word) or self.known[word]) + behind[tail]
        if len(self.known) < MOST_KNOWN:
            self.known.update(fresh)
            self.tails = behind
        return found

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Texts that cannot simply be split at every space."""
        odd = pc.match_substring_regex(texts, LOOSE_SPACE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return odd.to_numpy(zero_copy_only=False)

    def _cut(self, text: str) -> list[str]:
        if any(t in text for t in self.special):
            return [text]
        first, *others = PIECE.split(text)
        return [first, *(p[1:] for p in others)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and end."""
        if not self.by_piece:
            raw = self.whole(texts.to_pylist())
            return (np.frombuffer(b"".join(raw), "<u4"),
                    np.cumsum([0, *(len(r) // 4 for r in raw)]))
        if self._odd(texts).any():
            lists = pa.array([self._cut(t) for t in texts.to_pylist()], pa.list_(pa.large_string()))
        else:
            lists = pc.split_pattern(texts, " ")
        flat, begins = lists.flatten(), lists.offsets.to_numpy()
        begins = begins - begins[0]
        is_head = np.zeros(len(flat), bool)
        is_head[begins[:-1]] = True
        heads = self.whole(flat.filter(pa.array(is_head)).to_pylist())
        rest = flat.filter(pa.array(~is_head)).dictionary_encode()
        found = self.learned(rest.dictionary.to_pylist())
        which = np.empty(len(flat), np.int64)
        which[is_head] = len(found) + np.arange(len(heads))
        which[~is_head] = rest.indices.to_numpy()
        found += heads
        size = np.array([len(r) // 4 for r in found], np.int64)
        table = pa.LargeListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(size)])),
            pa.array(np.frombuffer(b"".join(found), "<u4")))
        ends = np.concatenate([[0], np.cumsum(size[which])])
        return table.take(pa.array(which)).flatten().to_numpy(), ends[begins]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for the tokenizer at ``path``, with what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def parts(texts: pa.Array, by_piece: bool) -> Iterator[tuple[pa.Array, bool]]:
    """The texts in runs of at most PART bytes; a longer text stands alone, and in several
    parts where it may be cut. True where a part ends its texts."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin = 0
    while begin < len(texts):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), PART, side="right")))
        if end - begin > 1 or sizes[begin] <= PART or not by_piece:
            yield texts[begin:end], True
        else:
            text = texts[begin].as_py()
            cuts = [0]
            for m in re.finditer(r"(?= [A-Za-z0-9])", text):
                if m.start() - cuts[-1] >= PART // 4:
                    cuts.append(m.start())
            for a, b in zip(cuts, [*cuts[1:], len(text)]):
                yield pa.array([text[a:b]], pa.large_string()), b == len(text)
        begin = end


# ---------------------------------------------------------------------------------------------
# The store


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block: int = 1 << 16,
          unit: str = "bit") -> None:
    """Encode ``text`` of every row of ``docs`` with the tokenizer in the file ``tokenizer`` (the
    same path on every machine), without special tokens, append ``end_id`` to each, and store
    the ids at ``path`` in ascending order of ``doc_id``.

    Null text counts as empty: its ids are ``end_id`` alone. A null id stands before all others;
    rows that share an id stand in the order of their texts' 64-bit hashes, then of the texts, so
    an id with a third of all rows is still spread over ranges. Other columns are not read.
    An empty table gives a store without rows. A task holds one Arrow batch of texts at a time.
    """
    id_type = docs.schema["doc_id"].dataType
    order = ["doc_id", "_hash", "text"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange("doc_id", "_hash")
    rows = rows.sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        at, begun, waiting, held = 0, 0, [], 0  # ids in chunks; of the open text; not yet in one

        def emit(kind, at, n, doc_ids, doc_type, sizes, packed):
            k = len(at)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * k), pa.array([shard] * k, pa.int32()), pa.array(at, pa.int64()),
                 pa.array(n, pa.int64()), doc_ids if doc_ids is not None else pa.nulls(k, doc_type),
                 pa.array(sizes, pa.list_(pa.int32())), pa.array(packed, pa.binary())],
                names=["kind", "shard", "at", "n", "doc_id", "sizes", "packed"])

        doc_type = None
        for batch in batches:
            doc_type, doc_at, doc_n = batch.column(0).type, [], []
            for texts, ended in parts(pc.cast(batch.column(1), pa.large_string()), encode.by_piece):
                ids, ends = encode.encode(texts)
                if ended:
                    ids = np.insert(ids, ends[1:], end_id)
                    n = np.diff(ends) + 1
                    n[0] += begun
                    doc_at += (at + held - begun + np.cumsum(n) - n).tolist()
                    doc_n += n.tolist()
                    begun = 0
                else:
                    begun += len(ids)
                waiting.append(ids)
                held += len(ids)
                if held >= block:
                    ids = np.concatenate(waiting)
                    full = held // block * block
                    packed = [to_planes(ids[i:i + block], unit) for i in range(0, full, block)]
                    yield emit("chunk", [at + i for i in range(0, full, block)],
                               [block] * len(packed), None, doc_type, *map(list, zip(*packed)))
                    waiting, at, held = [ids[full:].copy()], at + full, held - full
            yield emit("document", doc_at, doc_n, batch.column(0), doc_type,
                       [None] * len(doc_at), [None] * len(doc_at))
        if held:
            sizes, packed = to_planes(np.concatenate(waiting), unit)
            yield emit("chunk", [at], [held], None, doc_type, [sizes], [packed])

    stored = rows.mapInArrow(run, STORE.format(doc_id=id_type.simpleString()))
    # Planes are packed already.
    (stored.write.option("compression", "none").partitionBy("kind").parquet(path))


def read(spark: SparkSession, path: str, doc_type: str = "long") -> DataFrame:
    return spark.read.schema(STORE.format(doc_id=doc_type)).parquet(path)


def documents(spark: SparkSession, path: str, use: Callable[[bytes, object], object],
              result: str = "long", unit: str = "bit", doc_type: str = "long") -> DataFrame:
    """One row per stored document: ``doc_id, start`` (ids of all documents before it), ``n_tokens``
    and ``value``: what ``use`` makes of its ids. ``use`` is called with the bytes of some of the
    ids (32 bits each, little-endian) and with what it returned for those before them (None at
    first), so that a long document is never whole in memory.

    A task reads a shard in order and holds one chunk.
    """
    stored = read(spark, path, doc_type).where(F.col("kind").isin("chunk", "document"))
    # A chunk comes before the documents that begin in it.
    stream = stored.repartition("shard").sortWithinPartitions("shard", "at", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = ids = None  # of the chunk at hand
        open_row = None  # place in the shard, ids, ids still to come, id, value
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["kind"] == "chunk":
                    first = row["at"]
                    ids = from_planes(row["n"], row["sizes"], row["packed"], unit)
                    if open_row is None:
                        continue
                    shard, at, n, left, doc_id, value = open_row
                    begin = 0
                else:
                    shard, at, n, doc_id = row["shard"], row["at"], row["n"], row["doc_id"]
                    left, value, begin = n, None, at - first
                some = ids[begin:begin + left]
                value = use(some.tobytes(), value)
                left -= len(some)
                open_row = (shard, at, n, left, doc_id, value) if left else None
                if not left:
                    done.append((shard, at, n, doc_id, value))
            columns = list(zip(*done)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], batch.schema.field("doc_id").type),
                 pa.array(columns[4], value_type)],
                names=["shard", "at", "n_tokens", "doc_id", "value"])

    value_type = {"long": pa.int64(), "binary": pa.binary()}[result]
    found = stream.mapInArrow(
        run, f"shard int, at long, n_tokens long, doc_id {doc_type}, value {result}")
    # One row per shard, of which there are as many as the writer had tasks.
    sizes = read(spark, path, doc_type).where("kind = 'chunk'").groupBy("shard").agg(
        F.sum("n").alias("_ids"))
    before = sizes.select(F.col("shard").alias("_shard"), (F.sum("_ids").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ids"))
        .alias("_before"))
    return found.join(F.broadcast(before), F.col("shard") == F.col("_shard")).select(
        "doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "value")


def crc32_of(ids: bytes, before: int | None) -> int:
    """The running CRC-32 of a document's ids."""
    return zlib.crc32(ids, before or 0)


def joined(ids: bytes, before: bytes | None) -> bytes:
    """All ids of a document as bytes."""
    return (before or b"") + ids


def span(spark: SparkSession, path: str, shard: int, first: int, last: int,
         unit: str = "bit") -> np.ndarray:
    """The ids ``first`` to ``last`` (not included) of a shard, as a training loader reads them:
    the chunk index leads to the chunks that hold them, and no other is read."""
    rows = read(spark, path).where(
        (F.col("kind") == "chunk") & (F.col("shard") == shard)
        & (F.col("at") < last) & (F.col("at") + F.col("n") > first)).orderBy("at").collect()
    if not rows:
        return np.zeros(0, "<u4")
    ids = np.concatenate([from_planes(r["n"], r["sizes"], bytes(r["packed"]), unit) for r in rows])
    return ids[max(0, first - rows[0]["at"]):last - rows[0]["at"]]
