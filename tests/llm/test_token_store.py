import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import ODD, SF_DIR, rows

from tidemark.llm import token_store
from tidemark.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = token_store.Encoder(PATH)
ALPHABET = st.sampled_from(list("ab Z19'.,\n\t\x0b\x1c\x85\xa0é 日　") + ["<|endoftext|>", "  ", "'s", " the"])


def ids_of(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


def expected(table):
    """(doc_id, start, n_tokens, crc) one row after another, in the order that the store promises."""
    import xxhash
    out, start = [], 0
    key = lambda r: (r[0] is not None, r[0] or 0, np.uint64(
        xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64), r[1] or "")
    for doc_id, text in sorted(table, key=key):
        ids = [*ids_of(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def stored(spark, df, path, **options):
    token_store.write(df, path, PATH, **options)
    unit = {"unit": options["unit"]} if "unit" in options else {}
    return rows(token_store.documents(spark, path, token_store.crc32_of, **unit))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    ids, ends = ENCODER.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("unit", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
@pytest.mark.parametrize("most", [1, 200, 256, 50_257, 2 ** 32])
def test_planes(unit, n, most):
    ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint32)
    sizes, packed = token_store.to_planes(ids, unit)
    assert sum(sizes) == len(packed)
    assert token_store.from_planes(n, sizes, packed, unit).tolist() == ids.tolist()


def test_bit_planes_hold_one_bit_of_every_id():
    ids = np.array([5, 0, 7, 2, 1, 4, 6, 3, 258], np.uint32)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, :2].T
    planes = token_store.bits_apart(np.ascontiguousarray(raw))
    bits = np.unpackbits(planes, axis=1, count=len(ids), bitorder="little")
    for b in range(16):
        assert bits[b].tolist() == [int(i) >> b & 1 for i in ids]


@pytest.mark.parametrize("unit", ["bit", "byte"])
@pytest.mark.parametrize("block", [64, 1000])
def test_odd_rows(spark, odd, tmp_path, unit, block):
    found = stored(spark, odd, str(tmp_path / "s"), unit=unit, block=block)
    assert found == expected([r[:2] for r in ODD])


def test_clashing_columns_and_nothing(spark, clashing, nothing, tmp_path):
    assert stored(spark, clashing, str(tmp_path / "a")) == expected([r[:2] for r in ODD])
    assert stored(spark, nothing, str(tmp_path / "b")) == []


def test_long_text_in_parts(spark, tmp_path, monkeypatch):
    text = "".join(f"word{i} it's  {i % 7}.\n" for i in range(4000)) + "<|endoftext|> end"
    monkeypatch.setattr(token_store, "PART", 4096)
    found = list(token_store.parts(pa.array(["a", text, "", "b"], pa.large_string()), True))
    assert [e for _, e in found][-1] and len(found) > 20
    assert "".join(p[0].as_py() for p, _ in found if len(p) == 1 and p[0].as_py() != "a").startswith(text)
    ids = np.concatenate([ENCODER.encode(p)[0] for p, _ in found])
    assert ids.tolist() == ids_of("a") + ids_of(text) + ids_of("b")


def test_whole_query_and_round_trip(spark, docs, tmp_path):
    table = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = QUERIES["op13_token_planes"](spark, SF_DIR)
    assert rows(found.select("doc_id", "start", "n_tokens", "ids_crc32")) == expected(table)
    path = str(tmp_path / "s")
    token_store.write(docs, path, PATH, block=1000)
    whole = token_store.documents(spark, path, token_store.joined, "binary").collect()
    by_id = dict(table)
    for r in whole:
        ids = np.frombuffer(bytes(r["value"]), "<u4").tolist()
        assert ids == [*ids_of(by_id[r["doc_id"]]), 0] and len(ids) == r["n_tokens"]
    first = sorted(whole, key=lambda r: r["start"])[0]
    some = token_store.span(spark, path, 0, 3, first["n_tokens"])
    assert some.tolist() == np.frombuffer(bytes(first["value"]), "<u4").tolist()[3:]


def test_other_tokenizers_get_whole_texts(spark, odd, tmp_path):
    plan = json.load(open(PATH))
    plan["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "prefixed.json"
    path.write_text(json.dumps(plan))
    other = token_store.Encoder(str(path))
    assert not other.by_piece
    ids, ends = other.encode(pa.array(["a b", "", " c"], pa.large_string()))
    assert ids[:ends[1]].tolist() == other.tokenizer.encode("a b", add_special_tokens=False).ids
