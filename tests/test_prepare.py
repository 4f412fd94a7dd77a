"""Chunks, sentences and term counts, against plain Python."""

import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from colloquy.operators import prepare

SCHEMA = "conv_id long, turn long, role string, text string"
TEXT = st.text(alphabet=st.sampled_from("aAbB é ß\n.!? ,1"), max_size=120)


def frame(spark, texts):
    return spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], SCHEMA)


def plain_chunks(text, width, overlap):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    out, start = [], 0
    while words:
        out.append(" ".join(words[start : start + width]))
        if start + width >= len(words):
            break
        start += width - overlap
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=12), st.integers(1, 6), st.integers(0, 5))
def test_chunks(spark, texts, width, overlap):
    overlap = min(overlap, width - 1)
    rows = prepare.chunk(frame(spark, texts), width, overlap).collect()
    expected = [(i, j, c) for i, t in enumerate(texts) for j, c in enumerate(plain_chunks(t, width, overlap))]
    assert sorted((r["turn"], r["chunk"], r["text"]) for r in rows) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=12))
def test_terms(spark, texts):
    rows = prepare.terms(frame(spark, texts)).collect()
    expected = {(i, w): n for i, t in enumerate(texts) for w, n in Counter(re.findall(r"[^\W_]+", t.lower())).items()}
    assert {(r["turn"], r["term"]): r["tf"] for r in rows} == expected
    assert len(rows) == len(expected)


def test_sentences(spark):
    text = "First one. Second, at 3.14?! \n\n  Third line \nlast"
    rows = prepare.sentences(frame(spark, [text, "", None, " . "])).collect()
    assert [r["text"] for r in sorted(rows, key=lambda r: (r["turn"], r["sentence"]))] == [
        "First one.",
        "Second, at 3.14?!",
        "Third line",
        "last",
        ".",
    ]


def test_text_without_words_has_no_units(spark):
    df = frame(spark, [None, "", "   ", "..."])
    assert prepare.terms(df).count() == 0
    assert [r["text"] for r in prepare.chunk(df).collect()] == ["..."]


def test_overlap_must_be_less_than_width(spark):
    import pytest

    with pytest.raises(ValueError):
        prepare.chunk(frame(spark, ["a"]), 10, 10)


def test_no_shuffle_to_count_terms(spark):
    plan = prepare.terms(prepare.chunk(frame(spark, ["a b"])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
