"""Search over dense vectors: exact cosine, and locality-sensitive hashing.

Spark reads, cuts and shuffles the vectors; inside a task a batch of them is
compared with the requests as one matrix product, of which only the k best per
request are kept.
"""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.vectors import nonzero
from colloquy.operators import inside
from colloquy.operators.blocks import block_by_block, hit_schema, parts_of, to_all_tasks
from colloquy.operators.joins import join_small
from colloquy.operators.ranking import admitted, largest_k, rank_hits, restrict_to
from colloquy.schemas import CHUNK_KEY, REQUEST_FILTERS
from colloquy.session import Size, measure

# Requests measured to be within these bounds are one matrix that every task holds.
MATRIX = Size(rows=100_000, bytes=64 * 1024 * 1024)
GATHER = 50_000  # pairs whose vectors are copied out at a time


def hyperplanes(tables: int, bits: int, dim: int) -> np.ndarray:
    """(tables * bits, dim) of +1 and -1: + where the first hex digit of md5("table:bit:dimension") is even."""
    sign = lambda t, b, d: 1.0 - 2 * (int(hashlib.md5(f"{t}:{b}:{d}".encode()).hexdigest()[0], 16) % 2)
    rows = [[sign(t, b, d) for d in range(dim)] for t in range(tables) for b in range(bits)]
    return np.array(rows, dtype=np.float64).reshape(tables * bits, dim)


def probes(bits: int, flips: int) -> list[int]:
    """All numbers of `bits` bits with at most `flips` of them set: what to xor a code with to reach the codes near it."""
    return [code for code in range(1 << bits) if code.bit_count() <= flips]


def _searcher(key: Sequence[str], filters: Sequence[str], dim: int, limit: int, planes: tuple[int, int, int] | None):
    """Two functions for use inside tasks: one that reads requests, one that searches batches for them.

    With `planes` = (tables, bits, flips) only pairs whose codes differ in at most `flips` bits in some table are scored.
    """
    key, conditions_of = list(key), [c for c in filters if c != "k"]
    tile, gather = inside.TILE, GATHER
    values, forbidden = inside.make_values(), inside.make_forbidden()
    start, candidates, offer, result = inside.make_keeper(key, limit)
    tables, bits, flips = planes or (0, 0, 0)
    normals = hyperplanes(tables, bits, dim).T
    powers = 2 ** np.arange(bits)
    masks = np.array(probes(bits, flips))

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten()
        if column.null_count or flat.null_count or (np.diff(column.offsets.to_numpy()) != dim).any():
            raise ValueError(f"every vector must have {dim} values")
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)

    def codes(vectors: np.ndarray) -> np.ndarray:
        return ((vectors @ normals >= 0).reshape(len(vectors), tables, bits) * powers).sum(axis=2)

    def read(table) -> dict:
        """Requests with a vector that is not zero, as arrays."""
        vectors = matrix(table.column("vec"))
        length = np.sqrt((vectors * vectors).sum(axis=1))
        use = np.flatnonzero(length > 0)
        asked = {"id": values(table.column("req_id"))[use], "vec": vectors[use], "length": length[use]}
        asked["conditions"] = {c: table.column(c).take(pa.array(use)).to_pylist() for c in conditions_of}
        if planes:
            asked["codes"] = codes(asked["vec"])
        return asked

    def colliding(unit_codes: np.ndarray, request_codes: np.ndarray):
        """Pairs (unit, request) whose codes are near in some table, each once."""
        width = len(request_codes)
        met = np.zeros(len(unit_codes) * width, dtype=bool)
        for t in range(tables):
            probed = (request_codes[:, t, None] ^ masks).ravel()
            order = np.argsort(probed, kind="stable")
            ordered = probed[order]
            first = np.searchsorted(ordered, unit_codes[:, t], "left")
            count = np.searchsorted(ordered, unit_codes[:, t], "right") - first
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(np.arange(len(unit_codes)), count)
            met[row * width + order[np.repeat(first, count) + within] // len(masks)] = True
        return np.divmod(np.flatnonzero(met), width)

    def search(asked: dict, batches: Iterator) -> pa.RecordBatch | None:
        n_asked = len(asked["id"])
        state = start(n_asked)
        for batch in batches:
            units = matrix(batch.column("vec"))
            norms = np.sqrt((units * units).sum(axis=1))
            use = np.flatnonzero(norms > 0)
            if not len(use) or not n_asked:
                continue
            units, norms = units[use], norms[use]
            keys = {c: values(batch.column(c))[use] for c in key}
            roles = values(batch.column("role"))[use] if "roles" in conditions_of else None
            unit_codes = codes(units) if planes else None
            step = max(1, tile // len(use))
            for lo in range(0, n_asked, step):
                hi = min(n_asked, lo + step)
                vectors, length, floor = asked["vec"][lo:hi], asked["length"][lo:hi], state["floor"][lo:hi]
                ruled_out = None
                if conditions_of:
                    ruled_out = forbidden(asked["conditions"], lo, hi, len(use), keys.get("conv_id"), roles)
                if planes:
                    row, col = colliding(unit_codes, asked["codes"][lo:hi])
                    if ruled_out is not None:
                        keep = ~ruled_out[row, col]
                        row, col = row[keep], col[keep]
                    found = np.empty(len(row))
                    for at in range(0, len(row), gather):
                        part = slice(at, at + gather)
                        found[part] = np.einsum("ij,ij->i", units[row[part]], vectors[col[part]])
                    scores = np.full((len(use), hi - lo), -np.inf)
                    scores[row, col] = found / (norms[row] * length[col])
                else:
                    scores = (units @ vectors.T) / (norms[:, None] * length)
                    if ruled_out is not None:
                        scores[ruled_out] = -np.inf
                row, col = candidates(scores, floor)
                offer(state, col + lo, {c: keys[c][row] for c in key}, scores[row, col])
        return result(state, asked["id"])

    return read, search


def _needed(requests: DataFrame, vectors: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    roles = ["role"] if "roles" in filters and "role" not in key else []
    return requests.select("req_id", "vec", *filters), vectors.filter(F.col("vec").isNotNull()).select(*key, "vec", *roles), filters


def semantic_search(
    requests: DataFrame,
    vectors: DataFrame,
    k: int,
    key: Sequence[str] = CHUNK_KEY,
    matrix: Size = MATRIX,
    buckets: int | None = None,
) -> DataFrame:
    """Exact cosine top-k for each request (req_id, vec, conditions) over `vectors` (key, role, vec).

    Requests within `matrix` go to all tasks, and only k rows per request and task
    are shuffled. More requests than that, or more hits than a task should keep, are cut
    into blocks, each of which goes to all tasks in turn; the vectors stay where they are.
    `requests` are read more than once: pass a written table. Where all requests name
    meetings or speakers, others are not read; `buckets` is the number of a bucketed store's.
    """
    key = list(key)
    schema = hit_schema(requests, vectors, key)
    vectors = restrict_to(requests, vectors, buckets)
    requests, store, filters = _needed(requests, vectors, key)
    size, sample, limit = measure(requests), requests.first(), largest_k(requests, k)
    if sample is None:
        return rank_hits(requests.sparkSession.createDataFrame([], schema), key, k)
    read, search = _searcher(key, filters, len(sample["vec"]), limit, None)
    parts = parts_of(size, matrix, limit)
    if parts <= 1 and size.within(matrix.rows, matrix.bytes):
        hits = to_all_tasks(requests, store, read, search, schema)
    else:
        hits = block_by_block(requests, store, read, search, schema, 2 * parts)
    if "k" in filters:
        hits = join_small(hits, requests.select("req_id", "k"), ["req_id"], spread_by=key, size=size)
    return rank_hits(hits, key, k, limit)


def signatures(vectors: DataFrame, tables: int, bits: int, dim: int) -> DataFrame:
    """Add `sig`: per table the number whose bits say on which side of each hyperplane the vector lies."""
    normals = hyperplanes(tables, bits, dim).T
    powers = 2 ** np.arange(bits)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sides(vec: pa.Array) -> pa.Array:
        rows = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), dim)
        codes = ((rows @ normals >= 0).reshape(len(vec), tables, bits) * powers).sum(axis=2)
        offsets = np.arange(len(vec) + 1, dtype=np.int32) * tables
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.reshape(-1).astype(np.int64)))

    return vectors.withColumn("sig", sides(F.col("vec")))


def _cosine_udf():
    @F.arrow_udf(T.DoubleType())
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = (x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) for x in (a, b))
        dots = np.einsum("ij,ij->i", left, right)
        return pa.array(dots / np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1)))

    return cosine


def lsh_search(
    requests: DataFrame,
    vectors: DataFrame,
    k: int,
    dim: int,
    tables: int = 32,
    bits: int = 10,
    key: Sequence[str] = CHUNK_KEY,
    matrix: Size = MATRIX,
    flips: int = 1,
) -> DataFrame:
    """Approximate top-k: exact cosine, but only over units whose signature is near the request's.

    Near is: in some table at most `flips` of the `bits` bits differ. What share of the true hits that
    finds depends on how alike these are to the requests; the README has measured figures.
    Requests within `matrix` go to all tasks, as in `semantic_search`. More than that
    are joined with the vectors on (table, code), each with all codes near its own, with a salt
    so that one crowded code is spread over many tasks; a pair is scored in the first table
    where it meets, so none comes up twice.
    """
    key = list(key)
    schema = hit_schema(requests, vectors, key)
    requests, store, filters = _needed(requests, vectors, key)
    size, limit = measure(requests), largest_k(requests, k)
    if size.within(matrix.rows, matrix.bytes):
        read, search = _searcher(key, filters, dim, limit, (tables, bits, flips))
        hits = to_all_tasks(requests, store, read, search, schema)
        if "k" in filters:
            hits = join_small(hits, requests.select("req_id", "k"), ["req_id"], spread_by=key, size=size)
        return rank_hits(hits, key, k, limit)
    asked = signatures(requests.filter(nonzero("vec")), tables, bits, dim).withColumnsRenamed({"vec": "_vec", "sig": "_sig"})
    masks = probes(bits, flips)
    asked = asked.select("*", F.posexplode("_sig").alias("_table", "_own"))
    asked = asked.select("*", F.explode(F.array(*[F.col("_own").bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("_code")).drop("_own")
    store = signatures(store.filter(nonzero("vec")), tables, bits, dim)
    store = store.select("*", F.posexplode("sig").alias("_table", "_code"))
    first = F.array_position(F.zip_with("_sig", "sig", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= flips), True) == F.col("_table") + 1
    pairs = join_small(store, asked, ["_table", "_code"], spread_by=key, size=Size(size.rows * tables * len(masks), size.bytes * tables * len(masks)))
    scored = pairs.filter(first & admitted(filters)).withColumn("score", _cosine_udf()(F.col("_vec"), F.col("vec")))
    return rank_hits(scored, key, k, limit)
