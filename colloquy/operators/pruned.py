"""Exact cosine search over stored cells that leaves cells out by the triangle inequality.

No vector of a cell is nearer to a request than the angle between request and centre less the cell's reach. The cells
nearest to a request are searched first; what they give bounds its kth score from below, and every cell that could
still hold a better vector is searched then. The others are not read.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import inside
from colloquy.operators.blocks import hit_schema, parts_of
from colloquy.operators.dense import MATRIX
from colloquy.operators.joins import join_small
from colloquy.operators.ranking import largest_k, rank_hits
from colloquy.schemas import CHUNK_KEY, REQUEST_FILTERS
from colloquy.session import Size, materialise, measure
from colloquy.sources.vector_cells import read_cells

SLACK = 1e-6  # how far bounds and floors may be off; scores are ranked by 9 digits


def _tools(key: Sequence[str], filters: Sequence[str], limit: int, cells: tuple):
    """Functions for use inside tasks."""
    key, conditions_of, tile, slack = list(key), [c for c in filters if c != "k"], inside.TILE, SLACK
    values, forbidden = inside.make_values(), inside.make_forbidden()
    start, candidates, offer, result = inside.make_keeper(key, limit)
    names, centres, reach, sizes = cells
    at = {int(name): i for i, name in enumerate(names)}

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), centres.shape[1])

    def bounds(vectors: np.ndarray, length: np.ndarray, some=slice(None)) -> np.ndarray:
        """(requests, cells): a score that no vector of the cell exceeds."""
        angle = np.arccos(np.clip(vectors @ centres[some].T / length[:, None], -1, 1))
        return np.cos(np.maximum(angle - reach[some], 0))

    def read(table) -> dict:
        use = np.flatnonzero(table.column("vec").is_valid().to_numpy(zero_copy_only=False))
        table = table.take(pa.array(use))
        vectors = matrix(table.column("vec"))
        length = np.linalg.norm(vectors, axis=1)
        use = np.flatnonzero(length > 0)
        table = table.take(pa.array(use))
        asked = {"id": values(table.column("req_id")), "vec": vectors[use], "length": length[use]}
        asked["conditions"] = {c: table.column(c).to_pylist() for c in conditions_of}
        floor = table.column("floor").fill_null(-np.inf) if "floor" in table.column_names else pa.array(np.full(len(use), -np.inf))
        return asked | {"floor": np.array(values(floor), dtype=np.float64)}

    def nearest(asked: dict) -> tuple[np.ndarray, np.ndarray]:
        """(request, cell) places: per request the most promising cells that together hold `limit` vectors."""
        upper = bounds(asked["vec"], asked["length"])
        order = np.argsort(-upper, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        row, place = np.nonzero(before < limit)
        return row, order[row, place]

    def search(asked: dict, wants, batches: Iterator) -> pa.RecordBatch | None:
        state = start(len(asked["id"])) | {"floor": asked["floor"].copy()}
        for batch in batches:
            of = values(batch.column("cell"))
            for cell in np.unique(of):
                who = wants(at[int(cell)])
                part = batch.take(pa.array(np.flatnonzero(of == cell))) if len(who) else None
                if part is None:
                    continue
                units = matrix(part.column("vec"))
                norms = np.linalg.norm(units, axis=1)
                keys = {c: values(part.column(c)) for c in key}
                roles = values(part.column("role")) if "roles" in conditions_of else None
                step = max(1, tile // len(units))
                for lo in range(0, len(who), step):
                    some = who[lo : lo + step]
                    scores = (units @ asked["vec"][some].T) / (norms[:, None] * asked["length"][some])
                    if conditions_of:
                        mine = {c: [listed[j] for j in some] for c, listed in asked["conditions"].items()}
                        scores[forbidden(mine, 0, len(some), len(units), keys.get("conv_id"), roles)] = -np.inf
                    row, col = candidates(scores, state["floor"][some])
                    offer(state, some[col], {c: keys[c][row] for c in key}, scores[row, col])
        return result(state, asked["id"])

    def open_to(asked: dict, place: int) -> np.ndarray:
        """Requests that a cell may still serve."""
        return bounds(asked["vec"], asked["length"], [place])[:, 0] >= asked["floor"] - slack

    return read, nearest, search, open_to, bounds


def _once(spark: SparkSession, requests: DataFrame, path: str, filters: list[str], key: list[str], limit: int, schema) -> DataFrame:
    """All hits that may be among the best `limit` of requests that fit into a task, as a written table."""
    cells = read_cells(spark, path)
    read, nearest, search, open_to, bounds = _tools(key, filters, limit, cells)
    names, slack = cells[0], SLACK
    roles = ["role"] if "roles" in filters and "role" not in key else []
    stored = spark.read.parquet(path).select(*key, "vec", "cell", *roles)
    kind = requests.schema["req_id"].dataType.simpleString()

    def first_cells(batches):
        for batch in batches:
            asked = read(pa.Table.from_batches([batch]))
            if len(asked["id"]):
                row, place = nearest(asked)
                yield pa.RecordBatch.from_arrays([pa.array(asked["id"][row]), pa.array(names[place])], names=["req_id", "cell"])

    def places(asked: dict, table) -> dict[int, np.ndarray]:
        """The requests, of those at hand, that were searched in each cell at first."""
        by_id, where = {name: i for i, name in enumerate(asked["id"].tolist())}, {int(c): i for i, c in enumerate(names)}
        found: dict[int, list] = {}
        for name, cell in zip(table.column("req_id").to_pylist(), table.column("cell").to_pylist()):
            if name in by_id:
                found.setdefault(where[cell], []).append(by_id[name])
        return {cell: np.array(who) for cell, who in found.items()}

    pairs = materialise(requests.mapInArrow(first_cells, f"req_id {kind}, cell bigint"), "first-cells")
    near = sorted(row["cell"] for row in pairs.select("cell").distinct().collect())  # no more than there are cells
    sent = spark.sparkContext.broadcast((requests.toArrow(), pairs.toArrow()))

    def first(batches):
        asked = read(sent.value[0])
        wanted = places(asked, sent.value[1])
        hits = search(asked, lambda place: wanted.get(place, np.array([], dtype=int)), batches)
        if hits is not None:
            yield hits

    hits = materialise(stored.filter(F.col("cell").isin(near)).mapInArrow(first, schema), "first-hits")
    kth = rank_hits(hits, key, limit).filter(F.col("rank") == limit).select("req_id", (F.col("score") - SLACK).alias("floor"))
    bounded = materialise(join_small(requests, kth, ["req_id"], spread_by=["req_id"], how="left"), "bounded")

    def still_open(batches):
        for batch in batches:
            asked = read(pa.Table.from_batches([batch]))
            if len(asked["id"]):
                left = bounds(asked["vec"], asked["length"]) >= asked["floor"][:, None] - slack
                for place, who in places(asked, sent.value[1]).items():
                    left[who, place] = False
                yield pa.RecordBatch.from_arrays([pa.array(names[left.any(axis=0)])], names=["cell"])

    more = sorted(row["cell"] for row in bounded.mapInArrow(still_open, "cell bigint").distinct().collect())
    if not more:
        return hits
    floors = spark.sparkContext.broadcast(bounded.toArrow())

    def rest(batches):
        asked = read(floors.value)
        begun_in = places(asked, sent.value[1])

        def wants(place: int) -> np.ndarray:
            return np.setdiff1d(np.flatnonzero(open_to(asked, place)), begun_in.get(place, np.array([], dtype=int)))

        known: dict[int, np.ndarray] = {}
        found = search(asked, lambda place: known[place] if place in known else known.setdefault(place, wants(place)), batches)
        if found is not None:
            yield found

    return hits.unionAll(materialise(stored.filter(F.col("cell").isin(more)).mapInArrow(rest, schema), "later-hits"))


def pruned_search(
    spark: SparkSession, requests: DataFrame, path: str, k: int, key: Sequence[str] = CHUNK_KEY, matrix: Size = MATRIX
) -> DataFrame:
    """`semantic_search` over vectors that `store_cells` has stored under `path`: the same hits, from fewer files.

    `requests` (req_id unique, vec, conditions) are read more than once: pass a written table. They go to all tasks; beyond `matrix` they
    are cut into blocks that are searched one after the other. How much is left out depends on how the vectors
    lie: a request far from everything, or one whose conditions admit few units, opens all cells.
    """
    key, limit, size = list(key), largest_k(requests, k), measure(requests)
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    requests = requests.select("req_id", "vec", *filters)
    schema = hit_schema(requests, spark.read.parquet(path), key)
    if not size.rows or not len(read_cells(spark, path)[0]):
        return rank_hits(spark.createDataFrame([], schema), key, k)
    parts = parts_of(size, matrix, limit)
    found = None
    for part in range(parts):
        some = requests if parts == 1 else requests.filter(F.pmod(F.xxhash64("req_id"), F.lit(parts)) == part)
        hits = _once(spark, some, path, filters, key, limit, schema)
        found = hits if found is None else found.unionAll(hits)
    if "k" in filters:
        found = join_small(found, requests.select("req_id", "k"), ["req_id"], spread_by=key, size=size)
    return rank_hits(found, key, k, limit)
