"""Every registered query against its SQL, row by row."""

import compare
import pytest

import __spark_entry__ as entry_point

SF = "sf0.001"
QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, connection, name):
    schema, duck_schema, rows, duck_rows = compare.both(spark, connection, QUERIES[name], SQL[name], SF)
    assert schema == duck_schema
    assert rows == duck_rows
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, str(compare.TESTDATA / SF))
    assert df.count() > 0


def test_sql_has_a_query_each():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_three_hits_per_request(spark):
    rows = entry_point.entry(spark).collect()
    per_request = {}
    for row in rows:
        per_request.setdefault(row["req_id"], []).append(row["rank"])
    assert all(sorted(ranks) == [1, 2, 3] for ranks in per_request.values())
    assert len(per_request) == 40
