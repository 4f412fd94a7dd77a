"""Vectors stored as lists by code, in a quarter of their bytes, next to the vectors themselves.

Under `path` lie
    lists/t=../head=..    (key, role, code, small, scale, off): per table the list of each code, the upper bits of which name
                          the folder. `small` has a byte per component of the unit vector, in steps of `scale`; `off` is how
                          far the unit vector lies from what the bytes say, so any cosine is known to within `off`.
    vectors/slot=..       (key, vec) by a hash of the key, sorted by key
    settings              one row: tables, bits, dim, and the schemas of both, so that a search need not look for them
A code says on which side of each of `bits` planes a vector lies (`operators.dense.hyperplanes`).
"""

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.vectors import checked, nonzero
from colloquy.operators.dense import hyperplanes
from colloquy.schemas import CHUNK_KEY

BITS, HEAD = 12, 6  # bits of a code, and how many of them name a folder
SLOTS = 64
_SETTINGS = "tables int, bits int, dim int, lists string, vectors string"
_MADE = [("t", "int"), ("head", "int"), ("code", "int"), ("small", "binary"), ("scale", "double"), ("off", "double")]


def slot_of(key: Sequence[str]):
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")


def store_codes(vectors: DataFrame, path: str, dim: int, tables: int = 1, bits: int = BITS, key: Sequence[str] = CHUNK_KEY) -> None:
    """Store every vector of `vectors` (key, vec, and role if there is one) in one list of each table.

    NULL and zero vectors are left out, since no search returns them; a vector of another length than `dim` fails the job.
    `vectors` is read twice: pass a stored table. Both writes ask for a rebalance, so a list or slot that holds a third
    of all rows is written by several tasks.
    """
    if not (tables >= 1 and 1 <= bits <= 16):
        raise ValueError("at least one table, and codes of 1 to 16 bits")
    spark, carried = vectors.sparkSession, [*key, *(["role"] if "role" in vectors.columns and "role" not in key else [])]
    usable = vectors.filter(F.col("vec").isNotNull()).withColumn("vec", checked(F.col("vec"), dim)).filter(nonzero("vec"))
    normals, powers, low = hyperplanes(tables, bits, dim).T, 2 ** np.arange(bits), max(0, bits - HEAD)
    names = [name for name, _ in _MADE]

    def coded(batches):
        for batch in batches:
            n = batch.num_rows
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
            codes = ((rows @ normals >= 0).reshape(n, tables, bits) * powers).sum(axis=2)
            rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            scale = np.abs(rows).max(axis=1) / 127
            small = np.rint(rows / scale[:, None])
            off = np.linalg.norm(rows - small * scale[:, None], axis=1)
            small = pa.array([row.tobytes() for row in small.astype(np.int8)], pa.binary())
            for t in range(tables):
                own = [np.full(n, t), codes[:, t] >> low, codes[:, t]]
                made = [*[pa.array(x.astype(np.int32)) for x in own], small, pa.array(scale), pa.array(off)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *made], names=[*carried, *names])

    kinds = ", ".join([*[f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in carried], *[f"{name} {kind}" for name, kind in _MADE]])
    lists = usable.select(*carried, "vec").mapInArrow(coded, kinds)
    lists.hint("rebalance", "t", "head").write.mode("overwrite").partitionBy("t", "head").parquet(f"{path}/lists")
    slots = usable.select(*key, "vec", slot_of(key).alias("slot")).hint("rebalance", "slot").sortWithinPartitions("slot", *key)
    slots.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/vectors")
    row = [(tables, bits, dim, lists.schema.json(), slots.schema.json())]
    spark.createDataFrame(row, _SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def read_codes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, tuple[int, int, int]]:
    """The lists, the vectors, and (tables, bits, dim)."""
    row = spark.read.schema(_SETTINGS).parquet(f"{path}/settings").first()
    schema = lambda name: T.StructType.fromJson(json.loads(row[name]))
    lists = spark.read.schema(schema("lists")).parquet(f"{path}/lists")
    return lists, spark.read.schema(schema("vectors")).parquet(f"{path}/vectors"), (row["tables"], row["bits"], row["dim"])


def list_schema(lists: DataFrame, key: Sequence[str]) -> list[T.StructField]:
    return [lists.schema[c] for c in key]
