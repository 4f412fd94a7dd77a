"""Archives by an exact round trip; nearest vectors by brute force."""

import base64
import gzip
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import kd_search, warc
from colloquy.session import scratch_path

PAGES = "page_id long, url string, html string, file string, _sha int"
VECTORS = "vec_id long, embedding array<float>, id string, rank int"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>", "f", 1) for i in range(40)]
    rows += [(100, None, None, "f", 1), (101, "bad\r\nurl", "", "f", 1), (None, "u", "<p>3</p>", "f", 1), (None, "u", "alone", "f", 1)]
    rows += [(200, "same", "twice", "f", 1)] * 2 + [(300, "é", "日本\r\n\r\n😀" * 50_000, "f", 1)]
    return spark.createDataFrame(rows, PAGES).repartition(4).cache()


def test_records_are_read_back(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 3000)
    folder = scratch_path(spark, "test-warc")
    index = warc.write(pages, folder)
    back = warc.read(index).collect()
    winners = {}
    for r in pages.collect():
        if r["page_id"] is not None:
            winners[r["html"] or ""] = max(winners.get(r["html"] or "", -1), r["page_id"])
    expected = []
    for r in pages.collect():
        html = r["html"] or ""
        first = winners.get(html)
        refers = first if first is not None and (r["page_id"] is None or r["page_id"] < first) else None
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        expected.append((r["page_id"], len(html.encode()), digest, "revisit" if refers is not None else "response", refers, html.encode() if refers is None else None))
    key = lambda t: tuple(str(x) for x in t)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in back]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert index.select("file").distinct().count() > 4


def test_files_are_plain_archives_and_single_records_can_be_read(spark, pages):
    folder = scratch_path(spark, "test-warc")
    index = warc.write(pages, folder)
    for r in index.orderBy("file", "offset").limit(5).collect():
        path = r["file"].removeprefix("file:")
        with open(path, "rb") as f:
            f.seek(r["offset"])
            raw = gzip.decompress(f.read(r["length"]))
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    one = warc.read(index.where("page_id = 300")).collect()
    assert len(one) == 1 and one[0]["payload"].decode() == "日本\r\n\r\n😀" * 50_000
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_small_payloads_can_stay_responses(spark, pages):
    index = warc.write(pages, scratch_path(spark, "test-warc"), least=9)
    assert index.where("payload_bytes < 9 AND record_type = 'revisit'").count() == 0


def brute(rows, every, k):
    use = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, [math.floor(256 * np.float64(np.float32(x))) for x in v]))
    out, asked = [], set()
    for q, a in use:
        if (q, tuple(a)) in asked:
            continue
        asked.add((q, tuple(a)))
        if q is not None and q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i is None, i or 0) for i, b in use if i != q and len(a) == len(b))
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf", [4, 128])
def test_search_is_exact(spark, monkeypatch, leaf):
    monkeypatch.setattr(kd_search, "LEAF", leaf)
    monkeypatch.setattr(kd_search, "SHARD", 90)
    monkeypatch.setattr(kd_search, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # copies of one vector
    rows += [(2000, None), (2050, []), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2150, [float("nan")] * 6), (2200, [float("inf")] * 6)]
    rows += [rows[100], rows[100]]  # a query twice is asked once
    rows += [(2250, [1.0, 2.0]), (2300, [2.0, 1.0]), (None, rows[5][1]), (50, rows[7][1])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(3)
    got = kd_search.top_k(table, F.col("id") % 50 == 0, 5, 256)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 50, 5)
    assert kd_search.top_k(table.limit(0), F.col("id") % 50 == 0, 5, 256).count() == 0


def test_tree_boxes_are_tight_and_bounds_hold():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1000, 5))
    tree = kd_search.Tree(vectors, np.arange(1000))
    queries = rng.normal(size=(7, 5))
    bounds = tree.bounds(queries)
    for node, (a, b) in enumerate(tree.span):
        part = tree.vectors[a:b]
        if not tree.child[node]:
            assert b - a <= kd_search.LEAF and (part.min(0) == tree.low[node]).all() and (part.max(0) == tree.high[node]).all()
            assert (part @ queries.T <= bounds[:, node] + 1e-9).all()
