"""Words and shingles of columns against regular expressions."""

import pyarrow as pa
from conftest import low, words
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm.words import Words, by_bytes, shingles

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBéÉ \t\n\x0b\r\x1c ", max_size=30)), max_size=12)


@given(TEXTS, st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_keys_tell_words_apart(texts, skip):
    column = pa.array(texts, pa.string()).slice(skip)
    found, expected = Words(column), [words(low(t)) for t in texts[skip:]]
    assert found.counts.tolist() == [len(w) for w in expected]
    flat = [w for row in expected for w in row]
    keys = found.keys().tolist()
    assert len(set(zip(flat, keys, strict=True))) == len(set(flat)) == len(set(keys))
    runs, first = shingles(found.keys(), found.first, 3)
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in expected]
    assert [len(set(runs[a:b].tolist())) for a, b in zip(first[:-1], first[1:], strict=True)] == [len(s) for s in sets]


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 100, "c" * 10])], names=["text"])
    parts = [p.num_rows for p in by_bytes(batch, "text", 20)]
    assert sum(parts) == 5 and len(parts) >= 2
    assert list(by_bytes(batch.slice(0, 0), "text")) == []
