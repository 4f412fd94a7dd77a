"""Byte-level BPE against the library, fill-in-the-middle and manifests against plain Python."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import byte_bpe, fill_middle, manifest

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SIGNS = "abeinot THE'sl1290.,!?-_()<>|/\\\n\t\r\x1c\x85\xa0   　éßü日本語тест😀▁"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    ids, first = byte_bpe.coder(RANKS).encode(pa.array(texts, pa.string()))
    return [ids.to_numpy()[a:b].tolist() for a, b in zip(first, first[1:])]


@given(st.lists(st.one_of(st.none(), st.text(alphabet=SIGNS, max_size=80), st.text(max_size=40)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(library, texts):
    assert ids_of(texts) == [library.encode_ordinary(t or "") for t in texts]


@given(st.text(alphabet="abe in\n'1", max_size=400), st.sampled_from([4, 16, 64]))
@settings(max_examples=150, deadline=None)
def test_halves_of_texts_are_joined_right(library, text, block):
    whole, byte_bpe.BLOCK = byte_bpe.BLOCK, block
    try:
        made = b"".join(byte_bpe.coder(RANKS)._halves(text))
    finally:
        byte_bpe.BLOCK = whole
    assert np.frombuffer(made, "<u4").tolist() == library.encode_ordinary(text)


@given(st.binary(min_size=1, max_size=60), st.binary(min_size=1, max_size=60), st.sampled_from([b"", b"a" * 40, b" " * 90, b"abab" * 20]))
@settings(max_examples=300, deadline=None)
def test_monoid_join_is_the_encoding_of_both(a, b, run):
    monoid = byte_bpe.coder(RANKS).monoid
    a, b = a + run, run + b
    assert monoid.join(monoid.encode(a), monoid.encode(b)) == tuple(monoid._merge(a + b))


@pytest.mark.parametrize("text", ["x" * 5000, " " * 30_000 + "a", "ab" * 9000 + "\xa0 " + "hello world's " * 4000, "\n" * 10_001, "\xa0" + "'re " * 5000])
def test_long_runs(library, text):
    assert ids_of([text]) == [library.encode_ordinary(text)]


def test_encoding_and_decoding_all_rows(spark, library, odd, none):
    clash = odd.withColumns({"ids": F.lit("old"), "decoded": F.lit(1)})
    encoded = byte_bpe.encode_texts(clash, RANKS)
    rows = byte_bpe.decode_ids(encoded, RANKS).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {*odd.columns, "ids", "decoded"}
    for row in rows:
        text = row["text"] or ""
        assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(row["decoded"]).decode() == text
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(none, RANKS), RANKS).count() == 0
    lost = byte_bpe.decode_ids(encoded.select("doc_id", F.lit(None).cast("binary").alias("ids")), RANKS)
    assert {bytes(r["decoded"]) for r in lost.collect()} == {b""}


def parted(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(k % (len(units) + 1) for k in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_plain_python(spark, odd, odd_texts, none):
    more = ["a<P>b c d", "has <S> inside", "<M>", "<S<P x>", "P><S", "😀é" * 900 + "abc" * 700, "Zz9" * 3000, "\x00a\x00"]
    extra = spark.createDataFrame(rows_of(more * 12 + odd_texts * 6, first=1000), odd.schema)
    docs = odd.unionByName(extra).withColumns({"form": F.lit("old"), "output": F.lit(0)})
    made = fill_middle.fill_in_middle(docs)
    made = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    rows = made.collect()
    assert len(rows) == docs.count() and set(odd.columns) <= set(rows[0].asDict())
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == parted(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(none).count() == 0


@given(st.lists(st.text(alphabet="aZ é\n9", max_size=1500), max_size=5))
@settings(max_examples=60, deadline=None)
def test_every_boundary_is_found(texts):
    raw, offsets = fill_middle.flat(pa.array(texts, pa.string()))
    blocks = fill_middle.Blocks(raw, offsets)
    places, points, at, seen = [], [], 0, 0
    for text in texts:
        for unit in re.findall("[A-Za-z]+|[^A-Za-z]", text):
            places.append(at)
            points.append(seen)
            at, seen = at + len(unit.encode()), seen + len(unit)
    found = blocks.find(np.arange(len(places) + 1))
    assert found[0].tolist() == [*places, at] and found[1].tolist() == [*points, seen]
    if places:
        assert blocks.before(np.array(places))[0].tolist() == list(range(len(places)))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """(root, per leaf its siblings left and right, level by level)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p // fanout * fanout
            ways[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])))
            at[i] = p // fanout
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return (nodes[0] if nodes else None), ways


def plain_manifest(rows, fanout):
    groups = {}
    for group, order, leaf in rows:
        groups.setdefault(group, []).append((order is not None, order or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = tree([inner[g][0] for g in names], fanout)
    return sorted(
        (repr(g), repr(leaf), inner[g][0], root, repr(inner[g][1][i] + above[k])) for k, g in enumerate(names) for i, (_, _, leaf) in enumerate(sorted(groups[g]))
    )


@pytest.mark.parametrize(("sizes", "fanout"), [([1], 3), ([1, 1, 1, 1], 3), ([40, 1, 9, 10, 27, 28, 3], 3), ([17, 5], 2), ([70, 2], 4)])
def test_manifest_equals_plain_python(spark, sizes, fanout):
    rows = [(None if g == 1 else f"s{chr(233) if g == 2 else g}", None if i == 5 else i // 2 * 2, sha(f"{g}-{i // 3}"), "x", i) for g, n in enumerate(sizes) for i in range(n)]
    leaves = spark.createDataFrame(rows, "source string, doc_id long, leaf string, root string, _h int").repartition(3)
    made = manifest.manifest(leaves, "source", "doc_id", fanout=fanout)
    assert made.columns == ["source", "doc_id", "leaf", "_h", "subroot", "root", "proof"]
    checked = made.withColumns({"reached": manifest.folded(F.col("leaf"), F.col("proof")), "digest": manifest.proof_digest(F.col("proof"))})
    got = checked.collect()
    assert sorted((repr(r["source"]), repr(r["leaf"]), r["subroot"], r["root"], repr([tuple(s) for s in r["proof"]])) for r in got) == plain_manifest([r[:3] for r in rows], fanout)
    assert all(r["reached"] == r["root"] and r["digest"] == sha(*[s["l"] + s["r"] for s in r["proof"]]) for r in got)
    assert sorted(r["_h"] for r in got) == sorted(r[4] for r in rows)


def test_manifest_of_odd_rows(spark, odd, none):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = odd.withColumn("leaf", manifest.leaf_of(*fields))
    made = manifest.manifest(leaves, "source", "doc_id")
    got = made.withColumn("reached", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(got) == odd.count() and all(r["reached"] == r["root"] for r in got)
    tell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert all(r["leaf"] == sha(*[tell(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]) for r in got)
    empty = manifest.manifest(none.withColumn("leaf", F.lit("")), "source", "doc_id")
    assert empty.count() == 0 and set(empty.columns) == {*none.columns, "leaf", "subroot", "root", "proof"}
