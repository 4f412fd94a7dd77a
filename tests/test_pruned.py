"""Search over cells equals the search over everything, and leaves cells out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import dense, pruned
from colloquy.session import Size, materialise, scratch_path
from colloquy.sources.vector_cells import cells_path, store_cells

DIM = 12
KEYED = "conv_id long, turn long, chunk int, role string, vec array<double>"


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, DIM)) * 4
    vectors = middles[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, DIM)) * 0.4
    vectors[:1000] = vectors[0]  # a third of all rows is one vector, and ties throughout
    rows = [(i % 50, i // 50, i % 3, ["user", "bot", None][i % 3], v.tolist()) for i, v in enumerate(vectors)]
    rows += [(99, 0, 0, "user", [0.0] * DIM), (99, 1, 0, "user", None)]
    return materialise(spark.createDataFrame(rows, KEYED), "units")


@pytest.fixture(scope="module")
def cells(spark, units):
    path = scratch_path(spark, "cells")
    store_cells(units, path, DIM, cells=40)
    return path


def asked(spark, units, **conditions):
    rng = np.random.default_rng(5)
    near = [row["vec"] for row in units.filter("turn = 30 AND conv_id < 6").collect()]
    vectors = [*near, units.first()["vec"], *rng.normal(size=(4, DIM)).tolist(), [0.0] * DIM, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "req_id long, vec array<double>")
    for name, value in conditions.items():
        df = df.withColumn(name, F.expr(value))
    return materialise(df, "asked")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CONDITIONS = {
    "none": {},
    "speakers": {"roles": "IF(req_id % 2 = 0, array('bot'), NULL)"},
    "meetings": {"conv_ids": "IF(req_id % 2 = 0, array(3L, 44L), NULL)"},
    "own k, not a meeting": {"k": "IF(req_id % 3 = 0, 11, NULL)", "exclude_conv": "0L"},
}


@pytest.mark.parametrize("name", CONDITIONS)
def test_equals_the_search_over_everything(spark, units, cells, name):
    requests = asked(spark, units, **CONDITIONS[name])
    want = rows(dense.semantic_search(requests.filter("vec IS NOT NULL"), units, 4))
    assert rows(pruned.pruned_search(spark, requests, cells, 4)) == want
    assert want


def test_blocks_of_requests_find_the_same(spark, units, cells):
    requests = asked(spark, units)
    want = rows(dense.semantic_search(requests.filter("vec IS NOT NULL"), units, 7))
    assert rows(pruned.pruned_search(spark, requests, cells, 7, matrix=Size(4, 1 << 20))) == want


def test_cells_hold_every_vector_and_reach_it(spark, units, cells):
    stored, table = spark.read.parquet(cells), spark.read.parquet(cells_path(cells))
    assert stored.count() == 3000 and table.agg(F.sum("n")).first()[0] == 3000
    wide = stored.join(table, "cell").filter("angle > reach").count()
    assert wide == 0


def test_requests_near_one_cell_read_few_files(spark, units, cells):
    """Files of the cells that were ruled out may be unreadable: nobody opens them."""
    one = asked(spark, units).filter("req_id = 0")
    found = pruned._once(spark, one, cells, [], ["conv_id", "turn", "chunk"], 4, dense.hit_schema(one, units, ["conv_id", "turn", "chunk"]))
    from_cells = found.join(spark.read.parquet(cells), ["conv_id", "turn", "chunk"]).select("cell").distinct().count()
    assert from_cells <= 8


def test_empty_tables(spark, units, cells):
    none = scratch_path(spark, "no-cells")
    store_cells(units.limit(0), none, DIM)
    requests = asked(spark, units)
    assert rows(pruned.pruned_search(spark, requests, none, 3)) == []
    assert rows(pruned.pruned_search(spark, requests.limit(0), cells, 3)) == []


def test_all_vectors_alike(spark):
    path = scratch_path(spark, "alike")
    alike = spark.range(500).selectExpr("id % 5 AS conv_id", "id AS turn", "0 AS chunk", "'user' AS role", "array(1D, 2D) AS vec")
    store_cells(materialise(alike, "alike-units"), path, 2, cells=16)
    requests = materialise(spark.sql("SELECT 1L AS req_id, array(1D, 2D) AS vec"), "asked")
    got = rows(pruned.pruned_search(spark, requests, path, 3))
    assert [r[1:4] for r in got] == [(0, 0, 0), (0, 5, 0), (0, 10, 0)]
