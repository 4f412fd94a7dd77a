"""Bringing requests and units together in tasks: the requests go to all, at once or block by block."""

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.session import Size, materialise

MOST_HITS = 10_000_000  # hits that a task keeps: requests of a block times k


def hit_schema(requests: DataFrame, units: DataFrame, key: Sequence[str]) -> T.StructType:
    kinds = [("req_id", requests.schema["req_id"].dataType), *[(c, units.schema[c].dataType) for c in key]]
    return T.StructType([T.StructField(*kind) for kind in [*kinds, ("score", T.DoubleType())]])


def to_all_tasks(requests: DataFrame, units: DataFrame, read, search, schema: T.StructType) -> DataFrame:
    """Send the requests, measured to be small, to every task; the units are read once, where they lie."""
    shared = units.sparkSession.sparkContext.broadcast(requests.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = search(read(shared.value), batches)
        if found is not None:
            yield found

    return units.mapInArrow(scan, schema)


def parts_of(size: Size, bound: Size, k: int) -> int:
    """How many times the bound the requests are, in rows, bytes or hits kept; no more than there are requests."""
    over = max(-(-size.rows * k // MOST_HITS), -(-size.rows // max(1, bound.rows)), -(-size.bytes // max(1, bound.bytes)))
    return min(over, max(1, size.rows))


def block_by_block(requests: DataFrame, units: DataFrame, read, search, schema: T.StructType, blocks: int) -> DataFrame:
    """Cut the requests into blocks by a hash of their ids; one pass over the units per block, where these lie.

    What a task holds is one block. The units are never shuffled or copied, and a pass
    writes no more than the best hits of each task.
    """
    place = F.pmod(F.xxhash64("req_id"), F.lit(max(1, blocks)))
    found = None
    for block in range(max(1, blocks)):
        hits = materialise(to_all_tasks(requests.filter(place == block), units, read, search, schema), "hits")
        found = hits if found is None else found.unionAll(hits)
    return found
