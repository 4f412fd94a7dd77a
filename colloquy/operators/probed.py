"""Approximate cosine search over stored code lists, probed in the order in which they are likely to hold a hit.

A request probes in each table the codes that its vector is nearest to: those whose differing bits cost the least, a bit
costing the square of the request's distance from its plane. Of the lists probed every unit is looked at, in its one byte per
component. These give bounds on the cosine; a unit is left out only where its upper bound is below the kth lower bound,
and all others are scored with their vectors. So what is found is the exact top k of the lists probed, and with
share=1 the exact top k of all.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import inside
from colloquy.operators.blocks import hit_schema, parts_of
from colloquy.operators.dense import MATRIX, _cosine_udf, hyperplanes
from colloquy.operators.joins import join_small
from colloquy.operators.ranking import largest_k, rank_hits
from colloquy.schemas import CHUNK_KEY, REQUEST_FILTERS
from colloquy.session import Size, materialise, measure
from colloquy.sources.code_lists import HEAD, list_schema, read_codes, slot_of

SHARE = 0.5
SLACK = 1e-5  # how far bounds may be off; a floor is rounded to 6 digits
MOST_KEYS = 2_000  # pairs whose places one filter lists
FEW = 1_000  # requests whose lists are found without a job


def _tools(key: Sequence[str], filters: Sequence[str], limit: int, settings: tuple[int, int, int], share: float):
    """Functions for use inside tasks."""
    key, conditions_of, tile = list(key), [c for c in filters if c != "k"], inside.TILE
    values, forbidden = inside.make_values(), inside.make_forbidden()
    tables, bits, dim = settings
    normals, powers = hyperplanes(tables, bits, dim).T, 2 ** np.arange(bits)
    masks = np.arange(1 << bits)
    apart = ((masks[:, None] >> np.arange(bits)) & 1).astype(np.float64)
    n_probes, low = max(1, min(1 << bits, int(np.ceil(share * (1 << bits))))), max(0, bits - HEAD)

    def read(table) -> dict:
        table = table.take(pa.array(np.flatnonzero(table.column("vec").is_valid().to_numpy(zero_copy_only=False))))
        column = table.column("vec")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
        length = np.linalg.norm(vectors, axis=1)
        use = np.flatnonzero(length > 0)
        table = table.take(pa.array(use))
        asked = {"id": values(table.column("req_id")), "given": vectors[use], "vec": vectors[use] / length[use, None]}
        return asked | {"conditions": {c: table.column(c).to_pylist() for c in conditions_of}}

    def probed(vectors: np.ndarray, t: int) -> np.ndarray:
        """(requests, codes): whether a request looks into the list of a code."""
        margin = vectors @ normals[:, t * bits : (t + 1) * bits]
        own = ((margin >= 0) * powers).sum(axis=1)
        near = np.argsort((margin * margin) @ apart.T, axis=1, kind="stable")[:, :n_probes]
        out = np.zeros((len(vectors), 1 << bits), dtype=bool)
        np.put_along_axis(out, own[:, None] ^ near, True, axis=1)
        return out

    def folders(asked: dict) -> set[tuple[int, int]]:
        step = max(1, tile >> bits)
        found = set()
        for t in range(tables):
            for lo in range(0, len(asked["id"]), step):
                codes = np.flatnonzero(probed(asked["given"][lo : lo + step], t).any(axis=0))
                found |= {(t, int(head)) for head in np.unique(codes >> low)}
        return found

    def bounded(asked: dict, batches):
        """Pairs with the bounds on their cosine; left out are those that cannot be among the best of this task."""
        n_asked = len(asked["id"])
        best = np.full((n_asked, limit), -np.inf)  # the largest lower bounds so far
        step = max(1, tile >> bits)
        wants = {}  # per table and block of requests: asked again for every batch
        for batch in batches:
            n = batch.num_rows
            if not n or not n_asked:
                continue
            small = batch.column("small").cast(pa.large_binary())
            first, ends = np.frombuffer(small.buffers()[1], np.int64)[small.offset : small.offset + n + 1][[0, -1]]
            units = np.frombuffer(small.buffers()[2], np.int8)[first:ends].reshape(n, dim).astype(np.float32)
            scale, off = values(batch.column("scale")), values(batch.column("off")) + blur
            code, of = values(batch.column("code")), values(batch.column("t"))
            keys = {c: batch.column(c) for c in key}
            convs = values(batch.column("conv_id")) if "conv_id" in key and conditions_of else None
            roles = values(batch.column("role")) if "roles" in conditions_of else None
            across = max(1, min(step, tile // n))
            for lo in range(0, n_asked, across):
                hi = min(n_asked, lo + across)
                about = (units @ asked["vec"][lo:hi].T.astype(np.float32)).astype(np.float64) * scale[:, None]
                out = np.zeros((n, hi - lo), dtype=bool)
                for t in np.unique(of):
                    mine = np.flatnonzero(of == t)
                    if (t, lo, hi) not in wants:
                        wants = wants if len(wants) < 64 else {}
                        wants[t, lo, hi] = probed(asked["given"][lo:hi], int(t))
                    out[mine] = ~wants[t, lo, hi][:, code[mine]].T
                if conditions_of:
                    out |= forbidden(asked["conditions"], lo, hi, n, convs, roles)
                at_least = np.where(out, -np.inf, about - off[:, None])
                if n > limit:
                    at_least = np.partition(at_least, n - limit, axis=0)[n - limit :]
                if tables == 1:  # in several tables a unit comes up more than once, and its bound counts once
                    best[lo:hi] = np.sort(np.hstack([best[lo:hi], at_least.T]), axis=1)[:, -limit:]
                row, col = np.nonzero((about + off[:, None] >= best[lo:hi, 0] - slack) & ~out)
                if len(row):
                    score, wide = about[row, col], off[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked["id"][lo + col]), *[keys[c].take(pa.array(row)) for c in key], pa.array(score - wide), pa.array(score + wide)],
                        names=["req_id", *key, "least", "most"],
                    )

    slack, blur = SLACK, dim * 2.0**-23  # what products of single precision may be off by
    return read, folders, bounded


def _probed(spark: SparkSession, requests: DataFrame, path: str, filters: list[str], key: list[str], limit: int, share: float, size: Size) -> DataFrame:
    """(req_id, key, _asked, vec) of all pairs that may be among the best, for requests of `size`, which fit into a task."""
    lists, stored, settings = read_codes(spark, path)
    read, folders, bounded = _tools(key, filters, limit, settings, share)
    kind = requests.schema["req_id"].dataType
    table = requests.toArrow()
    sent = spark.sparkContext.broadcast(table)

    def opened(batches):
        for batch in batches:
            found = sorted(folders(read(pa.Table.from_batches([batch]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)], names=["t", "head"])

    if size.rows <= FEW:
        places = folders(read(table))
    else:  # 64 per table at most
        places = {(row["t"], row["head"]) for row in requests.mapInArrow(opened, "t int, head int").distinct().collect()}
    near = F.lit(False)
    for t in range(settings[0]):
        near = near | ((F.col("t") == t) & F.col("head").isin(sorted(head for of, head in places if of == t)))
    roles = ["role"] if "roles" in filters and "role" not in key else []

    def scan(batches):
        yield from bounded(read(sent.value), batches)

    schema = T.StructType([T.StructField("req_id", kind), *list_schema(lists, key), *[T.StructField(c, T.DoubleType()) for c in ("least", "most")]])
    pairs = lists.filter(near).select(*key, *roles, "t", "code", "small", "scale", "off").mapInArrow(scan, schema)
    if settings[0] > 1:
        pairs = pairs.groupBy("req_id", *key).agg(F.max("least").alias("least"), F.min("most").alias("most"))
    pairs = materialise(pairs, "bounded-pairs")
    kth = rank_hits(pairs.withColumn("score", F.col("least")), key, limit).filter(F.col("rank") == limit)
    # One row per request at most, so no larger than the requests.
    open_ = join_small(pairs, kth.select("req_id", (F.col("score") - SLACK).alias("floor")), ["req_id"], spread_by=key, how="left", size=size)
    open_ = open_.filter(F.col("floor").isNull() | (F.col("most") >= F.col("floor")))
    open_ = materialise(open_.select("req_id", *key, slot_of(key).alias("slot")), "open-pairs")
    some = open_.limit(MOST_KEYS + 1).collect()
    known = None
    if len(some) <= MOST_KEYS:  # what reaches the scan; the join asks for whole keys
        stored = stored.filter(F.col("slot").isin(sorted({row["slot"] for row in some})) & F.col(key[0]).isin(sorted({row[key[0]] for row in some})))
        known = Size(len(some), len(some) * 64 * (1 + len(key)))
    met = join_small(stored.drop("slot"), open_.drop("slot"), key, spread_by=["vec"], size=known)
    return join_small(met, requests.select("req_id", F.col("vec").alias("_asked")), ["req_id"], spread_by=key, size=size)


def probed_search(
    spark: SparkSession, requests: DataFrame, path: str, k: int, key: Sequence[str] = CHUNK_KEY, share: float = SHARE, matrix: Size = MATRIX
) -> DataFrame:
    """Top k per request (req_id unique, vec, conditions) of the lists that `store_codes` has stored under `path`.

    `share` of the codes of each table are probed: more of them find more of the true hits (measured in the README), all
    of them make the search exact. `requests` are read more than once: pass a written table. They go to all tasks; beyond
    `matrix` they are cut into blocks, one pass each. Units that tie with the kth hit within the bounds are all
    scored, so a crowd of equal vectors is read as a whole; none is held in one place.
    """
    key, limit, size = list(key), largest_k(requests, k), measure(requests)
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    requests = requests.select("req_id", "vec", *filters)
    parts = max(1, parts_of(size, matrix, limit))
    if not size.rows:
        return rank_hits(spark.createDataFrame([], hit_schema(requests, read_codes(spark, path)[0], key)), key, k)
    found = None
    for part in range(parts):
        some = requests if parts == 1 else requests.filter(F.pmod(F.xxhash64("req_id"), F.lit(parts)) == part)
        pairs = _probed(spark, some, path, filters, key, limit, share, size)
        found = pairs if found is None else found.unionAll(pairs)
    as_double = lambda c: F.col(c).cast("array<double>")
    scored = found.withColumn("score", _cosine_udf()(as_double("_asked"), as_double("vec"))).drop("_asked", "vec")
    if "k" in filters:
        scored = join_small(scored, requests.select("req_id", "k"), ["req_id"], spread_by=key, size=size)
    return rank_hits(scored, key, k, limit)
