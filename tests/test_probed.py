"""Search over stored code lists: exact where all lists are probed, bounds that hold, lists that are not read."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pruned import CONDITIONS, DIM, asked, rows, units  # noqa: F401

from colloquy.operators import dense, probed
from colloquy.session import Size, materialise, scratch_path
from colloquy.sources.code_lists import read_codes, store_codes


@pytest.fixture(scope="module")
def codes(spark, units):  # noqa: F811
    path = scratch_path(spark, "codes")
    store_codes(units, path, DIM, bits=7)
    return path


@pytest.mark.parametrize("name", CONDITIONS)
def test_probing_all_lists_is_exact(spark, units, codes, name):  # noqa: F811
    requests = asked(spark, units, **CONDITIONS[name])
    want = rows(dense.semantic_search(requests.filter("vec IS NOT NULL"), units, 4))
    assert rows(probed.probed_search(spark, requests, codes, 4, share=1)) == want
    assert want


def test_tables_and_blocks_of_requests_find_the_same(spark, units):  # noqa: F811
    path = scratch_path(spark, "codes")
    store_codes(units, path, DIM, tables=2, bits=3)
    requests = asked(spark, units)
    want = rows(dense.semantic_search(requests.filter("vec IS NOT NULL"), units, 7))
    assert rows(probed.probed_search(spark, requests, path, 7, share=1, matrix=Size(6, 1 << 20))) == want


def test_bounds_hold_and_every_vector_is_stored_once(spark, units, codes):  # noqa: F811
    lists, stored, settings = read_codes(spark, codes)
    assert settings == (1, 7, DIM) and lists.count() == stored.count() == 3000
    both = lists.join(stored, ["conv_id", "turn", "chunk"]).collect()
    for r in both[::7]:
        unit = np.array(r["vec"]) / np.linalg.norm(r["vec"])
        assert np.linalg.norm(unit - np.frombuffer(r["small"], np.int8) * r["scale"]) <= r["off"] + 1e-12


def test_few_lists_are_read_and_what_is_found_is_scored_exactly(spark, units, codes):  # noqa: F811
    requests = asked(spark, units).filter("req_id < 6")
    near = rows(probed.probed_search(spark, requests, codes, 4, share=0.05))
    exact = {r[:4]: r[5] for r in rows(dense.semantic_search(requests, units, 3000))}
    assert near and all(exact[r[:4]] == r[5] for r in near)
    one = requests.filter("req_id = 0")
    plan = probed._probed(spark, one, codes, [], ["conv_id", "turn", "chunk"], 4, 0.05, Size(1, 200))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slot#\d+ (IN|=|INSET)", plan)


def test_empty_tables(spark, units, codes):  # noqa: F811
    none = scratch_path(spark, "no-codes")
    store_codes(units.limit(0), none, DIM)
    requests = asked(spark, units)
    assert rows(probed.probed_search(spark, requests, none, 3)) == []
    assert rows(probed.probed_search(spark, requests.limit(0), codes, 3)) == []


def test_vectors_of_another_length_fail(spark):
    wrong = spark.sql("SELECT 1L AS conv_id, 1L AS turn, 0 AS chunk, array(1D, 2D, 3D) AS vec")
    with pytest.raises(Exception, match="vector of length 2 expected"):
        store_codes(wrong, scratch_path(spark, "wrong"), 2)


def test_all_vectors_alike(spark):
    path = scratch_path(spark, "alike")
    alike = spark.range(500).selectExpr("id % 5 AS conv_id", "id AS turn", "0 AS chunk", "array(1D, 2D) AS vec")
    store_codes(materialise(alike, "alike-units"), path, 2)
    requests = materialise(spark.sql("SELECT 1L AS req_id, array(1D, 2D) AS vec"), "asked")
    got = rows(probed.probed_search(spark, requests, path, 3))
    assert [r[1:4] for r in got] == [(0, 0, 0), (0, 5, 0), (0, 10, 0)]
