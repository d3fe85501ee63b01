"""The contracts' words in plain Python, for small inputs."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def remainder(doc_id, modulus):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % modulus


def simhash(text, shingle=4):
    w = words(text)
    if not w:
        return 0
    parts = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, distance=4):
    """The smallest id of each print's component, by all pairs of different prints."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    array = np.array(distinct, np.uint64)
    for i, p in enumerate(distinct):
        for q in array[i + 1:][np.bitwise_count(array[i + 1:] ^ np.uint64(p)) <= distance]:
            parent[find(int(q))] = find(p)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            root = find(p)
            least[root] = min(least.get(root, doc_id), doc_id)
    return [(d, p, least.get(find(p))) for d, p in prints]


def repeated(docs, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, hash of the rest) of each document."""
    first, out = {}, []
    for doc_id, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if doc_id is not None:
                first[s] = min(first.get(s, doc_id), doc_id)
    for doc_id, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            least = first.get(b[i:i + length])
            if least is not None and (doc_id is None or least < doc_id):
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(value):
    return re.sub("[^0-9]", "", value)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
}


def pii_spans(text):
    return [(kind, m.start(), m.end()) for kind, (pattern, holds) in PII.items()
            for m in re.finditer(pattern, text or "") if holds(m.group())]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m.group()) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text)
              if len(m.group()) >= 32]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def joined(spans):
    return ",".join("%s:%d:%d" % s for s in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contaminated(docs, items, window=10):
    """(doc_id, n_words, n_hit, items) of each document."""
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = {}
    for item, text in items:
        w = split.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = split.findall(lower(text)), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out
