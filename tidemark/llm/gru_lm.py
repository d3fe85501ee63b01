"""Language-model scores of whole documents by a gated recurrent network.

The network reads a document word by word and gives the next word's probability in two factors, the
word's class and the word in its class, each a softmax over about the root of the vocabulary. It is
trained in numpy by truncated backpropagation: the state is carried from window to window, the
gradient stays inside one. Scoring carries the state through the whole document.

The vocabulary holds the most frequent words of the corpus, the end of a document, and one symbol
for all other words. What stands behind that symbol has the smoothed share of its count in the
corpus. Counts and weights cover every training document: the driver fits a first network to a
sample (``sample_docs``), and from there on tasks train copies of it on all text, in rounds that
each take another share of the documents and end with the mean of the copies by their tokens.

Words are counted inside the tasks. The most frequent ones (at most ``frequent``, of at most
``LONGEST`` bytes, so at most 16 MB) go to every task; all others meet their counts in a join.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, let, written

HIDDEN = 16
STEPS = 16  # of a training window
SPAN = 32  # steps whose outputs are computed together
LONGEST = 64
# Bytes of text that a task splits into words at a time.
TEXT_BYTES = 8 << 20
LANES = 512
# Symbols of a piece in training: a text is cut into such pieces, so that it fills several lanes.
PIECE = 250
# Pieces that a task trains on together, and weights that are averaged together.
BLOCK, SLICE = 1024, 1024


def words_of(text: bytes | None) -> list[bytes]:
    """Split at the six ASCII white-space characters, A-Z in lower case."""
    return (text or b"").lower().split()


def parts_of(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of a column of texts as ``words_of`` has them, all in one array, and where each
    text's begin and the last one's end; at most ``TEXT_BYTES`` of text (or one text) at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
    low = 0
    while low < len(column):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
        part = pc.fill_null(pc.cast(column[low:high], pa.string()), "")
        split = pc.ascii_split_whitespace(pc.ascii_lower(part))
        words, cuts = split.flatten(), split.offsets.to_numpy()
        filled = pc.binary_length(words).to_numpy() > 0  # not before the first space or after the last
        if not filled.all():
            words = words.filter(pa.array(filled))
            cuts = np.concatenate([[0], np.cumsum(filled)])[cuts]
        yield words, cuts
        low = high
        # What follows, in numpy, could not use the memory that Arrow holds back.
        del part, split, words, cuts, filled
        pa.default_memory_pool().release_unused()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs``; partial counts leave a task in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _ in parts_of(batch.column(0)):
                word, n = words.value_counts().flatten()
                yield pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

    parts = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Model symbols: 0 the start of a document (never predicted), 1 its end, 2 any other word,
    then the most frequent words. ``ids`` also numbers frequent words outside the model, from
    ``size`` on; ``counts`` is by these numbers."""
    ids: dict[bytes, int]
    counts: np.ndarray
    size: int

    @property
    def width(self) -> int:
        """Symbols per class."""
        return max(1, math.isqrt(self.size))

    @property
    def classes(self) -> int:
        return -(-self.size // self.width)


END, OTHER = 1, 2


def vocabulary(counts: DataFrame, ends: int, size: int, frequent: int) -> Vocabulary:
    """The frequent words come to the driver, at most ``frequent`` of them: a histogram of the
    counts by eighths of a power of two says from which count on they fit."""
    level = F.floor(8 * F.log2("n")).cast("int")
    short = counts.where(F.octet_length("word") <= LONGEST)
    least, total = None, 0
    for row in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > frequent:
            break
        least = row["level"]
    rows = short.where(level >= least).select("word", "n").collect() if least is not None else []
    rows = sorted(((r["n"], r["word"].encode()) for r in rows), key=lambda r: (-r[0], r[1]))
    inside = rows[:size - 3]
    n = np.array([0, ends, 0, *[r[0] for r in rows]], np.int64)
    return Vocabulary({w: i + 3 for i, (_, w) in enumerate(rows)}, n, 3 + len(inside))


@dataclass
class Network:
    """Input weights by symbol, state weights, and the two output layers (classes; symbols)."""
    symbols_in: np.ndarray  # (3, size, H): update, reset and candidate
    state_in: np.ndarray  # (3, H, H), to be multiplied from the left
    bias_in: np.ndarray  # (3, 1, H)
    class_out: np.ndarray  # (classes, H)
    class_bias: np.ndarray  # (classes)
    word_out: np.ndarray  # (classes, width, H)
    word_bias: np.ndarray  # (classes, width)

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return (self.symbols_in, self.state_in, self.bias_in, self.class_out, self.class_bias,
                self.word_out, self.word_bias)

    def vector(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.parts])

    def like(self, vector: np.ndarray) -> Network:
        """A network of this one's shapes with the weights of ``vector``."""
        cuts = np.cumsum([a.size for a in self.parts])[:-1]
        return Network(*[v.reshape(a.shape).astype(np.float32)
                         for v, a in zip(np.split(vector, cuts), self.parts)])


def initial(vocab: Vocabulary, others: int, seed: int = 5) -> Network:
    """Random weights, and biases that give each symbol its share of the corpus."""
    rng = np.random.default_rng(seed)
    h, size, classes, width = HIDDEN, vocab.size, vocab.classes, vocab.width
    share = np.full(classes * width, 1e-9)
    share[:size] = vocab.counts[:size] + 0.5
    share[OTHER] = others + 0.5
    share[0] = 1e-9
    share = share.reshape(classes, width)
    word = np.log(share / share.sum(axis=1, keepdims=True))
    word[np.arange(classes * width).reshape(classes, width) >= size] = -60.0

    def drawn(columns: int, scale: float) -> np.ndarray:
        values = (rng.standard_normal((3 * h, columns)) * scale).astype(np.float32)
        return np.ascontiguousarray(values.reshape(3, h, columns).transpose(0, 2, 1))

    return Network(
        drawn(size, 0.4),
        drawn(h, 0.3),
        np.zeros((3, 1, h), np.float32),
        (rng.standard_normal((classes, h)) * 0.1).astype(np.float32),
        np.log(share.sum(axis=1) / share.sum()).astype(np.float32),
        (rng.standard_normal((classes, width, h)) * 0.1).astype(np.float32),
        word.astype(np.float32))


def squash(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|) in place."""
    room = np.abs(x, out=room)
    room += 1
    return np.divide(x, room, out=x)


def forward(net: Network, codes: np.ndarray, state: np.ndarray, keep: bool = False):
    """States (steps, lanes, H) after reading ``codes`` (steps, lanes); a document's start (symbol
    0) clears the state first. With ``keep`` also what backpropagation needs."""
    h = HIDDEN
    steps, lanes = codes.shape
    found = np.empty((steps, lanes, h), np.float32)
    xs = np.empty((steps if keep else 1, 3, lanes, h), np.float32)
    inwards = np.empty((steps if keep else 1, lanes, h), np.float32)
    room = np.empty((2, lanes, h), np.float32)
    symbols_in = net.symbols_in + net.bias_in
    starts = (codes == 0).any(axis=1).tolist()
    kept = []
    for t in range(steps):
        x, inward = xs[t if keep else 0], inwards[t if keep else 0]
        start = codes[t] == 0 if starts[t] else None
        if start is not None:
            state = np.where(start[:, None], np.float32(0), state)
        for weights, own in zip(symbols_in, x):
            np.take(weights, codes[t], axis=0, out=own, mode="clip")
        gates, candidate = x[:2], x[2]
        gates += np.matmul(state, net.state_in[:2], out=room)
        squash(gates, room)
        gates += 1
        gates *= 0.5
        np.matmul(state, net.state_in[2], out=inward)
        candidate += np.multiply(gates[1], inward, out=room[0])
        squash(candidate, room[0])
        if keep:
            kept.append((t, state, start, x, inward))
        change = np.subtract(candidate, state, out=room[0])
        change *= gates[0]
        state = np.add(state, change, out=found[t])
    return (found, kept) if keep else found


def by_number(numbers: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The stable order of ``numbers`` (0 to ``most``), those that occur, and where each starts and
    ends in it."""
    # Narrow integers are sorted by their digits.
    numbers = numbers.astype(np.min_scalar_type(most))
    order = np.argsort(numbers, kind="stable")
    ends = np.cumsum(np.bincount(numbers, minlength=1))
    starts = np.concatenate([[0], ends[:-1]])
    found = np.flatnonzero(ends > starts)
    return order, found, starts[found], ends[found]


# Up to here exponentials, their sums over a class and products with weights stay inside single
# precision.
REACH = 60
# Columns of a softmax that are taken together, so that they stay in a core's cache.
COLUMNS = 1024


def with_bias(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """The weights (..., symbols, H) with the bias, less its maximum, as a further column, and
    whether a softmax needs its largest term subtracted: states lie between -1 and 1, so that no
    term, and not the largest one, is further from 0 than the sum of its row's weights."""
    both = np.concatenate([weights, (bias - bias.max(axis=-1, keepdims=True))[..., None]], axis=-1)
    return both, bool(np.abs(weights).sum(axis=-1).max() > REACH)


def softmax_at(weights: np.ndarray, far: bool, rows: np.ndarray, target: np.ndarray,
               grad: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The log-softmax of ``weights`` times each of ``rows`` at the row's target. ``far``: subtract
    the largest term first. With ``grad`` the gradient by the weights of minus the sum over ``n``
    is added there, and that by the rows, less the last column, returned."""
    x = weights @ rows.T
    if far:
        x -= x.max(axis=0)
    at = target * len(rows) + np.arange(len(rows))
    found = x.take(at)
    d = np.exp(x, out=x)
    total = d.sum(axis=0)
    found -= np.log(total)
    if grad is None:
        return found, None
    d.ravel()[at] -= total
    # Dividing the rows takes fewer steps than dividing all terms.
    scale = (1 / (total * n))[:, None]
    grad += d @ (rows * scale)
    back = d.T @ weights[:, :-1]
    back *= scale
    return found, back


def outputs(net: Network, seen: np.ndarray, target: np.ndarray, grads: list | None = None):
    """The natural log-probability of each target given the states ``seen`` (H, n). With
    ``grads`` the gradients of minus their mean are added there, and that of ``seen`` returned."""
    classes, width = net.word_bias.shape
    h, n = seen.shape
    # The symbols of a class side by side.
    order, *groups = by_number(target // width, classes)
    target = target[order]
    kind = target // width
    place = target - kind * width
    rows = np.ones((n, h + 1), seen.dtype)  # the last column meets the bias
    rows[:, :h] = np.take(seen.T, order, axis=0)
    found = np.zeros(n, seen.dtype)
    class_grad = word_grad = back = None
    if grads is not None:
        class_grad, word_grad = (np.zeros((*a.shape, h + 1), a.dtype) for a in (net.class_bias, net.word_bias))
        back = np.zeros((n, h), seen.dtype)

    def add(weights: np.ndarray, far: bool, low: int, high: int, numbers: np.ndarray, grad) -> None:
        for start in range(low, high, COLUMNS):
            part = slice(start, min(start + COLUMNS, high))
            values, ahead = softmax_at(weights, far, rows[part], numbers[part], grad, n)
            found[part] += values
            if back is not None:
                back[part] += ahead

    weights, far = with_bias(net.class_out, net.class_bias)
    add(weights, far, 0, n, kind, class_grad)
    weights, far = with_bias(net.word_out, net.word_bias)
    for k, low, high in zip(*(g.tolist() for g in groups)):
        add(weights[k], far, low, high, place, None if grads is None else word_grad[k])
    values = np.empty_like(found)
    values[order] = found
    if grads is None:
        return values
    for i, grad in ((3, class_grad), (5, word_grad)):
        grads[i] += grad[..., :h]
        grads[i + 1] += grad[..., h]
    ahead = np.empty_like(back)
    ahead[order] = back
    return values, ahead.T


def lanes_of(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents laid one after another in lanes of about equal length, the longest lane first:
    the symbols read, the symbols to predict (-1 behind a lane's end), and the document of each,
    (steps, lanes). A document's first symbol may be inverted: it is read and not predicted."""
    lanes = max(1, min(lanes, len(docs)))
    heap = [(0, k) for k in range(lanes)]
    rows: list[list[int]] = [[] for _ in range(lanes)]
    for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        length, k = heapq.heappop(heap)
        rows[k].append(i)
        heapq.heappush(heap, (length + len(docs[i]), k))
    rows = [rows[k] for _, k in sorted(heap, key=lambda lane: (-lane[0], lane[1]))]
    steps = max(length for length, _ in heap)
    read, predicted, owner = (np.full((lanes, steps), v, np.int32) for v in (0, -1, 0))
    for k, own in enumerate(rows):
        at = 0
        for i in own:
            doc = docs[i]
            end = at + len(doc)
            predicted[k, at:end] = doc
            read[k, at + 1:end] = doc[:-1]
            owner[k, at:end] = i
            if len(doc) and doc[0] < 0:  # context: read, not predicted
                predicted[k, at] = -1
                read[k, at + 1:at + 2] = ~doc[0]
            at = end
    # One by one, so that no more than one of them is held twice.
    read = read.T.copy()
    predicted = predicted.T.copy()
    return read, predicted, owner.T.copy()


def pieces(doc: np.ndarray) -> list[np.ndarray]:
    """The document in pieces of ``PIECE`` symbols. Each but the first begins with the symbol
    before it, inverted: that one is read and not predicted."""
    return [doc[:PIECE], *[np.concatenate([~doc[at - 1:at], doc[at:at + PIECE]])
                           for at in range(PIECE, len(doc), PIECE)]]


def states_at(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the states (steps, lanes, H) those at flat places of (steps, lanes), (H, n); each state
    lies in one piece, since they are taken one by one."""
    rows = found.reshape(-1, found.shape[2])
    return (rows if len(at) == len(rows) else np.take(rows, at, axis=0)).T


class Trainer:
    """Adam on windows of ``STEPS`` words, the state carried from one to the next."""

    def __init__(self, net: Network, rate: float = 0.006) -> None:
        self.net, self.rate, self.step = net, rate, 0
        self.first = [np.zeros_like(a) for a in net.parts]
        self.second = [np.zeros_like(a) for a in net.parts]
        self.room = [np.empty_like(a) for a in net.parts]

    def learn(self, docs: list[np.ndarray], lanes: int) -> None:
        """One pass over ``docs``."""
        h, net = HIDDEN, self.net
        read, predicted, _ = lanes_of(docs, lanes)
        state = np.zeros((read.shape[1], h), np.float32)
        for low in range(0, len(read), STEPS):
            codes, target = read[low:low + STEPS], predicted[low:low + STEPS]
            found, kept = forward(net, codes, state, keep=True)
            state = found[-1]
            at = np.flatnonzero(target >= 0)
            if not len(at):
                continue
            grads = [np.zeros_like(a) for a in net.parts]
            _, back = outputs(net, states_at(found, at), target.ravel()[at], grads)
            ahead = back.T
            if len(at) < target.size:
                ahead = np.zeros((target.size, h), np.float32)
                ahead[at] = back.T
            ahead = ahead.reshape(*target.shape, h)
            flow, rest, room = (np.zeros_like(state) for _ in range(3))
            slope, through = (np.empty((k, *state.shape), np.float32) for k in (2, 3))
            onward = net.state_in.transpose(0, 2, 1)
            # By the update, the reset, and the candidate's part of the state and of the symbol.
            inputs = np.empty((4, *codes.shape, h), np.float32)
            for t, before, start, x, inward in reversed(kept):
                flow += ahead[t]
                gates, candidate, d_in = x[:2], x[2], inputs[:, t]
                d_update, d_reset, d_state, d_symbol = d_in
                np.multiply(flow, gates[0], out=d_symbol)
                np.subtract(flow, d_symbol, out=rest)
                np.subtract(1, np.abs(candidate, out=room), out=room)
                room *= room
                d_symbol *= room
                np.subtract(candidate, before, out=d_update)
                d_update *= flow
                np.multiply(d_symbol, inward, out=d_reset)
                np.minimum(gates, np.subtract(1, gates, out=slope), out=slope)
                slope *= slope
                slope *= 2
                d_in[:2] *= slope
                np.multiply(d_symbol, gates[1], out=d_state)
                grads[1] += np.matmul(before.T, d_in[:3])
                for part in np.matmul(d_in[:3], onward, out=through):
                    rest += part
                if start is not None:
                    rest[start] = 0
                flow, rest = rest, flow
            order, used, cut, _ = by_number(codes.ravel(), net.symbols_in.shape[1])
            for own, d_in in zip(grads[0], (inputs[0], inputs[1], inputs[3])):
                # Two numbers side by side are added up as one complex number.
                rows = np.take(d_in.reshape(-1, h), order, axis=0).view(np.complex64)
                own[used] = np.add.reduceat(rows, cut, axis=0).view(np.float32)
            grads[2] += grads[0].sum(axis=1, keepdims=True)
            self.update(grads)

    def update(self, grads: list[np.ndarray]) -> None:
        """One step of Adam, in place; ``grads`` are used up."""
        self.step += 1
        for a, g, m, v, room in zip(self.net.parts, grads, self.first, self.second, self.room):
            np.subtract(g, m, out=room)
            room *= 0.1
            m += room
            g *= g
            g -= v
            g *= 0.01
            v += g
            np.divide(v, 1 - 0.99 ** self.step, out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(m, 1 - 0.9 ** self.step, out=room)
            room *= self.rate
            room /= g
            a -= room


def train(net: Network, docs: list[np.ndarray], epochs: int = 4, lanes: int = 64,
          rate: float = 0.006) -> Network:
    trainer = Trainer(net, rate)
    for _ in range(epochs if docs else 0):
        trainer.learn(docs, lanes)
    return net


def log_probability(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """The natural log-probability of each document's symbols, its end included."""
    sums = np.zeros(len(docs))
    if not docs:
        return sums
    read, predicted, owner = lanes_of(docs, LANES)
    state = np.zeros((read.shape[1], HIDDEN), np.float32)
    ends = (predicted >= 0).sum(axis=0)  # falling: the lanes that have not ended come first
    low = 0
    while low < len(read):
        live = int(np.searchsorted(-ends, -low))
        # Few lanes take more steps together.
        high = low + SPAN * max(1, LANES // (2 * live))
        part = slice(low, high), slice(0, live)
        found = forward(net, read[part], state[:live])
        state, low = found[-1], high
        target = predicted[part]
        at = np.flatnonzero(target >= 0)
        values = outputs(net, states_at(found, at), target.ravel()[at])
        sums += np.bincount(owner[part].ravel()[at], values, len(docs))
    return sums


@dataclass
class Model:
    """What scoring needs: the network, the vocabulary, and the totals of the corpus."""
    net: Network
    vocab: Vocabulary
    tokens: int  # N
    distinct: int  # V
    other_tokens: int  # outside the network's vocabulary
    other_distinct: int

    def base(self, count):
        """Of a token with this count: log10((c + 0.5) / (N + 0.5 (V + 1)))."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def other(self, count):
        """Of a word behind the symbol for other words."""
        return np.log10((count + 0.5) / (self.other_tokens + 0.5 * (self.other_distinct + 1)))


def symbols(ids: dict[bytes, int], words: list[bytes], other: int = -1) -> np.ndarray:
    """Numbers of the words by ``ids`` (``other`` for those not in it), then the end."""
    numbers = chain(map(ids.get, words, repeat(other)), (END,))
    return np.fromiter(numbers, np.int32, len(words) + 1)


class Numbers:
    """The same for whole columns, inside a task; much smaller than ``ids``."""

    def __init__(self, ids: dict[bytes, int], other: int = -1) -> None:
        self.words = pa.array(list(ids), pa.binary()).cast(pa.string())
        # In the last place that of the words which are not in ``ids``.
        self.ids = np.array([*ids.values(), other], np.int32)

    def of(self, words: pa.Array) -> np.ndarray:
        return self.ids[pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()]


def with_ends(numbers: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """The numbers of each text (between two of ``cuts``), then the end."""
    bounds = cuts + np.arange(len(cuts))
    every = np.full(bounds[-1], END, np.int32)
    word = np.ones(len(every), bool)
    word[bounds[1:] - 1] = False
    every[word] = numbers
    return [every[low:high] for low, high in zip(bounds.tolist(), bounds[1:].tolist())]


def counted_by_text(words: pa.Array, owner: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of each of ``n`` texts, how often each occurs in it, and how many each
    text has; ``owner`` is each word's text."""
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    found, times = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary.take(pa.array(found % size)), times, np.bincount(found // size, minlength=n)


def network_ids(vocab: Vocabulary) -> dict[bytes, int]:
    """The numbers of the words that the network knows."""
    return {w: i for w, i in vocab.ids.items() if i < vocab.size}


def for_network(vocab: Vocabulary, numbers: np.ndarray) -> np.ndarray:
    return np.where((numbers < 0) | (numbers >= vocab.size), OTHER, numbers)


def averaged(docs: DataFrame, net: Network, vocab: Vocabulary, rate: float) -> Network:
    """The mean, by tokens, of the networks that the tasks make of ``net`` from all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((net, Numbers(network_ids(vocab), OTHER)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, numbers = shared.value
        trainer = Trainer(start.like(start.vector()), rate)
        block: list[np.ndarray] = []
        tokens = 0
        for batch in batches:
            for words, cuts in parts_of(batch.column(0)):
                for doc in with_ends(numbers.of(words), cuts):
                    tokens += len(doc)
                    block += pieces(doc)
                    while len(block) >= 2 * BLOCK:
                        trainer.learn(block[:BLOCK], BLOCK)
                        del block[:BLOCK]
        if block:
            # Fewer lanes make more steps of the rest, which is all that a small input has.
            trainer.learn(block, max(64, len(block) // 4))
        if tokens:
            vector = trainer.net.vector()
            places = range(0, len(vector), SLICE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), pa.array([tokens] * len(places), pa.int64()),
                 pa.array([vector[i:i + SLICE].tobytes() for i in places], pa.binary())],
                names=["place", "tokens", "weights"])

    def mean(table: pa.Table) -> pa.Table:
        # In one order, so that the sum does not depend on the order of tasks.
        rows = sorted(zip(table["tokens"].to_pylist(), table["weights"].to_pylist()))
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for n, w in rows)
        return pa.table({"place": table["place"][:1], "tokens": pa.array([sum(n for n, _ in rows)]),
                         "weights": pa.array([(total / sum(n for n, _ in rows)).tobytes()], pa.binary())})

    schema = "place int, tokens long, weights binary"
    found = sorted(docs.select("text").mapInArrow(run, schema).groupBy("place")
                   .applyInArrow(mean, schema).collect())
    shared.unpersist()
    return net.like(np.concatenate([np.frombuffer(r["weights"]) for r in found])) if found else net


def learn(docs: DataFrame, counts: DataFrame, size: int = 2048, frequent: int = 250_000,
          sample_docs: int = 400, rounds: int = 4) -> Model:
    """``counts`` are the word counts of all of ``docs``. The network starts from a fit to the
    ``sample_docs`` documents with the smallest hash of their id; then tasks train it on all of
    ``docs``, every document in one of the ``rounds``."""
    ends = docs.count()
    vocab = vocabulary(counts, ends, size, frequent)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    inside = int(vocab.counts[3:vocab.size].sum())
    others = total["n"] - inside
    chosen = (docs.select("doc_id").where(F.col("doc_id").isNotNull())
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
              .select(F.col("doc_id").alias("_id")))
    sample = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")
    # Of a long document eight pieces spread over it, so that the driver's first fit stays bounded.
    words = F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")
    spread = let(words, lambda w: F.when(F.size(w) <= 8 * PIECE, F.array(w)).otherwise(F.array(
        *[F.slice(w, F.floor((F.size(w) - PIECE) * j / 7).cast("int") + 1, PIECE) for j in range(8)])))
    first: list[np.ndarray] = []
    ids = network_ids(vocab)
    for row in sorted(sample.select("doc_id", spread.alias("words")).collect()):
        for j, part in enumerate(row["words"]):
            doc = symbols(ids, words_of(" ".join(part).encode()), OTHER)
            if j + 1 < len(row["words"]):
                doc = doc[:-1]  # no end here
            if j > 0:
                doc[:1] = ~doc[:1]  # read, not predicted
            first.append(doc)
    net = train(initial(vocab, others), first)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for k in range(rounds):
        net = averaged(docs.where(share == k), net, vocab, 0.006 / (k + 1))
    return Model(net, vocab, total["n"] + ends, total["v"] + (ends > 0), others,
                 total["v"] - (vocab.size - 3))


def scored(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    slim = replace(model, vocab=replace(model.vocab, ids={}))
    shared = spark.sparkContext.broadcast((slim, Numbers(model.vocab.ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbers = shared.value
        # By a word's number, and in the last place for words without one.
        numbered = len(model.vocab.counts)
        base = np.append(model.base(model.vocab.counts), 0.0)
        other = np.append(model.other(model.vocab.counts), 0.0)
        other[:model.vocab.size] = 0.0
        seen = np.append(model.vocab.counts > 0, False)
        inside = for_network(model.vocab, np.append(np.arange(numbered, dtype=np.int32), np.int32(-1)))
        for batch in batches:
            docs, sums = [], []
            rare: list[pa.Array] = []
            times, different = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for words, cuts in parts_of(batch.column(2)):
                found = numbers.of(words)
                for doc in with_ends(found, cuts):
                    sums.append((len(doc), np.count_nonzero(seen[doc]), base[doc].sum(), other[doc].sum()))
                    docs.append(inside[doc])
                unseen = np.flatnonzero(found < 0)
                counted = counted_by_text(words.take(pa.array(unseen)), np.searchsorted(
                    cuts, unseen, side="right") - 1, len(cuts) - 1)
                for own, part in zip((rare, times, different), counted):
                    own.append(part)
            logs = log_probability(model.net, docs) / math.log(10)
            tokens, known, bases, others = (np.array(c) for c in zip(*sums)) if sums else [
                np.zeros(0)] * 4
            cuts = np.cumsum(np.concatenate(different))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens.astype(np.int64)),
                 pa.array(known.astype(np.int64)), pa.array(bases.astype(np.float64)),
                 pa.array(logs + others),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                     [pa.concat_arrays([pa.array([], pa.string()), *rare]),
                      pa.array(np.concatenate(times))], names=["word", "n"]))],
                names=["doc_id", "row_hash", "n_tokens", "known", "base", "model", "rare"])

    first = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.xxhash64("doc_id", "text").alias("row_hash"), "text").mapInArrow(
            run, "doc_id long, row_hash long, n_tokens long, known long, base double, model double, "
                 "rare array<struct<word:string,n:long>>"), "scores")
    # Equal rows have equal rare words: once is enough.
    rare = (first.where(F.size("rare") > 0).dropDuplicates(["row_hash"])
            .select("row_hash", F.explode("rare").alias("r"))
            .select("row_hash", "r.word", F.col("r.n").alias("times")))
    c = F.coalesce(F.col("n"), F.lit(0))

    def log(total: float, distinct: int):
        return F.col("times") * F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct + 1)))

    extra = (
        rare.join(counts, "word", "left").groupBy(F.col("row_hash").alias("_key"))
        .agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"),
             F.sum(log(model.tokens, model.distinct)).alias("more_base"),
             F.sum(log(model.other_tokens, model.other_distinct)).alias("more_model"))
    )
    zero = F.lit(0.0)
    return first.drop("rare").join(extra, F.col("row_hash") == F.col("_key"), "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", zero)).alias("score"))


def score_documents(docs: DataFrame, modulus: int = 5, kept_out: int = 1, **options) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from those that are not held out:
    doc_id, held_out, n_tokens (words and the end), n_known (of them seen in training),
    train_tokens, base_score (unigram) and score (the network), both log10 of the probability.

    A null text is an empty one: its only token is the end. A null id counts as the empty text
    when documents are held out, and is not in the network's sample. Repeated rows get equal
    scores and count as often as they occur. Without training documents every word is unseen.
    """
    docs = docs.select("doc_id", "text")
    training = docs.where(held(F.col("doc_id"), modulus) != kept_out)
    counts = written(word_counts(training), "words")
    model = learn(training, counts, **options)
    return scored(docs, counts, model).select(
        "doc_id", (held(F.col("doc_id"), modulus) == kept_out).alias("held_out"), "n_tokens",
        "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
