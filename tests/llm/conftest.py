import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, _rest int"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate(LOW)


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", None, 1.5, "x", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, control strings, repeated lines, several scripts, and a very long text."""
    base = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
    return [
        None, "", " \t\n ", "one", "a b c d", "A b C d e", "a B c D e", base, base, base + " tail", "\x1c x y", "日本語 テスト 😀 é",
        "<|endoftext|> </s> [INST] x [/INST] <s>", "line one here\nline one here\nother | line\n\nline one here", "x" * 5000,
        " ".join(f"w{i % 5000}" for i in range(30_000)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The odd texts with extra columns, a null id, null columns and repeated rows, over several partitions."""
    rows = rows_of(odd_texts)
    rows += [(None, "row without id and some words in it", None, None, None, None, None, None), rows[7], rows[7]]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
