"""Row-by-row comparison of a registered query with its SQL."""

import math
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted((TESTDATA / sf).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


TYPES = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


def both(spark, connection, query, sql: str, sf: str):
    """Schema and sorted rows of a query, and of its SQL."""
    df = query(spark, str(TESTDATA / sf))
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    schema = sorted((name, TYPES[kind]) for name, kind in df.dtypes)
    duck_schema = sorted((d[0], str(d[1])) for d in result.description)
    return schema, duck_schema, rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
