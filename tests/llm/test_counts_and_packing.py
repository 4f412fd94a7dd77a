"""Token counts and packing against the tokenizers' own libraries."""

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import words  # noqa: F401  the fixtures' module
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import packing, pretokens, token_counts
from colloquy.llm.words import by_bytes

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = "abeinot THE'sl1290.,!?-_()<>|/\\\n\t\r\x1c   　éßü日本語тест😀▁"


@given(st.text(alphabet=SIGNS, max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts_and_ids_are_those_of_the_libraries(text):
    library = test_counts_and_ids_are_those_of_the_libraries
    if not hasattr(library, "sp"):
        library.sp, library.t = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(JSON)
    assert token_counts.merger(MODEL).count(text) == len(library.sp.encode(text))
    ids = np.frombuffer(packing.encoder(JSON).encode(text + "<|endoftext|>"), "<u4").tolist()
    assert ids == library.t.encode(text + "<|endoftext|>", add_special_tokens=False).ids


def test_token_counts_of_all_rows(odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, MODEL, 4096).collect())
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert got == sorted((i is None, i or 0, len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in texts)
    assert any(r[4] for r in got) and token_counts.count_tokens(none, MODEL, 4096).count() == 0


def test_pieces_are_packed_without_gaps(odd, none):
    t = Tokenizer.from_file(JSON)
    rows = packing.pack(packing.pieces(odd, JSON, 64, 2, keep_ids=True), 64).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) <= 64
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    copies = {}
    for r in odd.collect():
        copies[r["doc_id"]] = (copies.get(r["doc_id"], (0,))[0] + 1, r["text"] or "")
    assert set(by_doc) == set(copies)
    for doc, (times, text) in copies.items():
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        found = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert len(found) == times * -(-len(ids) // 64)
        joined = [r["ids"] for r in found[::times]]
        assert sum(joined, []) == ids and [r["start"] for r in found[::times]] == [sum(map(len, joined[:i])) for i in range(len(joined))]
        assert all(len(x) == 64 for x in joined[1:])
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.02 * total / 64 + 2
    assert packing.pack(packing.pieces(none, JSON, 64, 2), 64).count() == 0


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 50)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_plans_hold_the_histogram_exactly(counts):
    histogram = np.zeros(41, np.int64)
    for length, n in counts:
        histogram[length] += n
    held = np.zeros(41, np.int64)
    plans = packing.plan(histogram, 40)
    for pattern, repeats in plans:
        assert repeats > 0 and sum(k * v for k, v in pattern.items()) <= 40
        for k, v in pattern.items():
            held[k] += v * repeats
    assert (held == histogram).all()


@pytest.mark.parametrize("scale", [1, 1000])
def test_packing_is_near_the_bound(scale):
    rng = np.random.default_rng(0)
    histogram = np.bincount(np.minimum(1024, rng.lognormal(5.5, 1, 3000).astype(int) + 1), minlength=1025) * scale
    sequences = sum(r for _, r in packing.plan(histogram, 1024))
    assert sequences <= 1.01 * -(-int((histogram * np.arange(1025)).sum()) // 1024) + 1


@pytest.mark.parametrize("kept", [1 << 20, 100])
def test_words_of_columns_before_are_looked_up(monkeypatch, kept):
    monkeypatch.setattr(pretokens, "KEPT", kept)
    library, columns, asked = Tokenizer.from_file(JSON), packing.Encoder(JSON).columns, []
    encode = columns.words
    columns.words = lambda words: asked.append(len(words)) or encode(words)
    for texts in (["a new word here", "word  two\n x"], ["here two new"], ["other word", None, "here three new"], ["here three new"]):
        ids, first = columns.encode(pa.array(texts, pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids.to_pylist()[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == want
    assert asked[0] == 7 and len(asked) == 3 and asked[1] <= 1


def test_columns_are_cut_small():
    """What numpy holds at once follows from SLICE, not from the batch."""
    texts = pa.array([" ".join(f"w{i * j % 9973}" for i in range(2000)) for j in range(1, 800)])
    columns = packing.Encoder(JSON).columns
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    tracemalloc.start()
    for part in by_bytes(batch, "text", packing.SLICE):
        columns.encode(part.column(0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 8 << 20 and peak < 20 << 20
