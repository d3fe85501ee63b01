"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read the bytes of a text, one forwards and one backwards; both states
at a byte give that byte a probability for each language, and the mean over all bytes is the
document's. The network is trained in numpy by backpropagation through time.

A text is read in windows, all of them side by side: each window starts ``MARGIN`` bytes early,
so that the state has context when it reaches the window's own bytes, from either side. Every
byte of every text is labelled, whatever its length, in memory that does not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.common import fresh, held, texts

HIDDEN = 8
WINDOW = 112
MARGIN = 16
SPAN = WINDOW + 2 * MARGIN
PAD = 256  # stands before and after a text
UNKNOWN = "und"
# Windows that a task reads side by side.
LANES = 2048


@dataclass
class Network:
    """Per direction the weights of the bytes and of the state, each for the update gate, the
    reset gate and the candidate; then the output layer. Lanes are the last axis everywhere."""
    bytes_in: np.ndarray  # (2, 3H, 257)
    state_in: np.ndarray  # (2, 3H, H)
    out: np.ndarray  # (languages, 2H)
    bias: np.ndarray  # (languages)
    languages: tuple[str, ...] = ()

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.bytes_in, self.state_in, self.out, self.bias


def initial(languages: tuple[str, ...], seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    return Network(
        rng.standard_normal((2, 3 * h, 257)).astype(np.float32),
        (rng.standard_normal((2, 3 * h, h)) * 0.5).astype(np.float32),
        (rng.standard_normal((len(languages), 2 * h)) * 0.3).astype(np.float32),
        np.zeros(len(languages), np.float32), languages)


def squash(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|) in place, the units' sigmoid: its slope is (1 - |y|) ** 2."""
    room = np.abs(x, out=room)
    room += 1
    return np.divide(x, room, out=x)


def states(net: Network, codes: np.ndarray, side: int, keep: bool = False):
    """The states of one direction, (span, H, windows); ``codes`` is (span, windows). With
    ``keep`` also what backpropagation needs."""
    h = HIDDEN
    steps, lanes = codes.shape
    table, inner = net.bytes_in[side], net.state_in[side]
    state = np.zeros((h, lanes), np.float32)
    found = np.empty((steps, h, lanes), np.float32)
    x, y, room = (np.empty((3 * h, lanes), np.float32) for _ in range(3))
    kept = []
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        np.take(table, codes[t], axis=1, out=x, mode="clip")
        np.matmul(inner, state, out=y)
        gates = np.add(x[:2 * h], y[:2 * h], out=x[:2 * h])
        squash(gates, room[:2 * h])
        gates += 1
        gates *= 0.5
        candidate = x[2 * h:]
        candidate += gates[h:] * y[2 * h:]
        squash(candidate, room[2 * h:])
        if keep:
            kept.append((t, state, x.copy(), y[2 * h:].copy()))
        candidate = candidate - state
        candidate *= gates[:h]
        state = np.add(state, candidate, out=found[t])
    return (found, kept) if keep else found


def label(net: Network, codes: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Each position's probabilities, (positions, languages, windows)."""
    h = HIDDEN
    logits = net.out[:, :h] @ states(net, codes, 0)[start:stop]
    logits += net.out[:, h:] @ states(net, codes, 1)[start:stop]
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(net: Network, codes: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy of all the windows' own positions that lie in a text."""
    h = HIDDEN
    both = [states(net, codes, s, keep=True) for s in (0, 1)]
    logits = net.out[:, :h] @ both[0][0] + net.out[:, h:] @ both[1][0] + net.bias[:, None]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = codes != PAD
    own[:MARGIN] = own[-MARGIN:] = False
    p[:, target, np.arange(len(target))] -= 1
    p *= own[:, None, :] / max(1, own.sum())
    grads = [np.zeros_like(a) for a in net.parts]
    grads[3] += p.sum(axis=(0, 2))
    for side, (found, kept) in enumerate(both):
        part = slice(side * h, side * h + h)
        grads[2][:, part] += np.matmul(p, found.transpose(0, 2, 1)).sum(axis=0)
        back = net.out[:, part].T @ p
        inner = net.state_in[side]
        flow = np.zeros_like(back[0])
        for t, before, x, inward in reversed(kept):
            flow = flow + back[t]
            gates, candidate = x[:2 * h], x[2 * h:]
            update, reset = gates[:h], gates[h:]
            d_candidate = flow * update * (1 - np.abs(candidate)) ** 2
            # A gate is (1 + y) / 2 with y = squash(a): half of y's slope.
            slope = 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            d_gates = np.concatenate([flow * (candidate - before), d_candidate * inward]) * slope
            d_state = np.concatenate([d_gates, d_candidate * reset])
            order = np.argsort(codes[t], kind="stable")
            used, first = np.unique(codes[t][order], return_index=True)
            grads[0][side][:, used] += np.add.reduceat(
                np.concatenate([d_gates, d_candidate])[:, order], first, axis=1)
            grads[1][side] += d_state @ before.T
            flow = flow * (1 - update) + inner.T @ d_state
    return grads


def windows(text: bytes) -> np.ndarray:
    """(windows, span): the text's bytes cut into windows with their margins."""
    n = -(-len(text) // WINDOW)
    line = np.full(n * WINDOW + 2 * MARGIN, PAD, np.intp)
    line[MARGIN:MARGIN + len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(line, SPAN)[::WINDOW]


def train(samples: list[tuple[bytes, str]], steps: int = 240, batch: int = 128,
          rate: float = 0.02, seed: int = 1) -> Network:
    """Adam over the windows of the samples, in an order fixed by the seed, again and again until
    at least ``steps`` batches are done."""
    languages = tuple(sorted({lang for _, lang in samples}))
    net = initial(languages, seed)
    cut = [windows(t) for t, _ in samples]
    codes = np.concatenate(cut) if cut else np.zeros((0, SPAN), np.intp)
    target = np.repeat([languages.index(lang) for _, lang in samples], [len(c) for c in cut])
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(a) for a in net.parts]
    second = [np.zeros_like(a) for a in net.parts]
    step = 0
    while len(codes) and step < steps:
        order = rng.permutation(len(codes))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            step += 1
            for a, g, m, v in zip(net.parts, gradients(net, codes[rows].T, target[rows]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return net


def pooled(net: Network, found: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean of the labels of all bytes of each text, none of them empty.
    Windows of different texts are read side by side, ``LANES`` at a time."""
    sums = np.zeros((len(found), len(net.languages)))
    lanes, owners, waiting = [], [], 0

    def flush() -> None:
        codes = np.concatenate(lanes)
        owner = np.concatenate(owners)
        for i in range(0, len(codes), LANES):
            part = np.ascontiguousarray(codes[i:i + LANES].T)
            p = label(net, part, MARGIN, -MARGIN)
            p *= (part[MARGIN:-MARGIN] != PAD)[:, None, :]
            np.add.at(sums, owner[i:i + LANES], p.sum(axis=0).T)

    for k, text in enumerate(found):
        cut = windows(text)
        for i in range(0, len(cut), LANES):  # a very long text is read in parts
            lanes.append(cut[i:i + LANES])
            owners.append(np.full(len(lanes[-1]), k))
            waiting += len(lanes[-1])
            if waiting >= LANES:
                flush()
                lanes, owners, waiting = [], [], 0
    if lanes:
        flush()
    return sums / np.array([[max(1, len(t))] for t in found])


def samples(docs: DataFrame, per_language: int, longest: int) -> list[tuple[bytes, str]]:
    """Labelled texts to learn from: of each language the ``per_language`` documents with the
    smallest hash of their id, cut to at most ``longest`` windows each, spread over the text.
    Both bounds are parameters of ``identify``; the documents are picked by id alone, so that
    only their texts are read."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", "lang").withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= per_language).select(F.col("doc_id").alias("_id"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, parts = [], [], []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                          texts(batch.column(2))):
                n = -(-len(text) // WINDOW)
                for i in sorted({n * j // longest for j in range(longest)}) if n else []:
                    ids.append(doc_id)
                    langs.append(lang)
                    parts.append(text[i * WINDOW:(i + 1) * WINDOW])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()),
                 "part": pa.array(parts, pa.binary())})

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")
        .mapInArrow(cut, "doc_id long, lang string, part binary").collect()
    )
    return sorted({(bytes(r["part"]), r["lang"]) for r in rows})


def learn(docs: DataFrame, per_language: int = 200, longest: int = 6) -> Network:
    """The network trained on ``docs`` (doc_id, text, lang)."""
    return train(samples(docs, per_language, longest))


def label_all(docs: DataFrame, net: Network) -> DataFrame:
    """Every column of ``docs`` with ``lang_pred`` and ``score``, the probability of that language
    over all bytes of the text. ``und`` with score 0 if the text is null, has no letter, or if
    no language was learned. Of languages that score alike the first by code point is taken.
    Repeated rows are labelled alike. Columns of these names in ``docs`` are replaced."""
    docs = docs.drop("lang_pred", "score")
    (letters,) = fresh(docs, "_letters")
    rows = docs.withColumn(letters, F.coalesce(F.rlike("text", F.lit("\\p{L}")), F.lit(False)))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    at, last = docs.columns.index("text"), len(docs.columns)
    languages = net.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            able = batch.column(last).to_numpy(zero_copy_only=False).astype(bool)
            found = [t for t, ok in zip(texts(batch.column(at)), able) if ok] if languages else []
            names = np.full(len(able), UNKNOWN, object)
            scores = np.zeros(len(able))
            if found:
                p = pooled(net, found)
                names[able] = np.array(languages, object)[p.argmax(axis=1)]
                scores[able] = np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(names, pa.string()), pa.array(scores)],
                names=schema.names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, modulus: int = 4, kept_out: int = 2, per_language: int = 200,
             longest: int = 6) -> DataFrame:
    """``label_all`` with a network learned from the labelled documents that are not held out,
    with ``held_out``, true where crc32 of the id as text modulo ``modulus`` is ``kept_out``."""
    docs = docs.drop("held_out")
    out = held(F.col("doc_id"), modulus) == kept_out
    net = learn(docs.where(~out), per_language, longest)
    return label_all(docs.withColumn("held_out", out), net)
