"""Vectors stored in cells, so that a search can tell which of them cannot hold a hit.

A cell holds the vectors whose nearest centre, by angle, is its own. Next to the vectors lies a table of one row per
cell: its centre, its reach (the largest angle between the centre and a vector in it) and its number of vectors.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.vectors import checked, nonzero
from colloquy.schemas import CHUNK_KEY

CELLS = 256
MOST_CELLS = 16_384
SAMPLE = 20_000  # vectors the centres are fitted on
ROUNDS = 8


def fit_centres(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on a sample; fewer centres than asked for where the sample has fewer directions."""
    rows = np.unique(rows / np.linalg.norm(rows, axis=1, keepdims=True), axis=0)
    pick = np.random.default_rng(0).permutation(len(rows))[:cells]
    centres = rows[np.sort(pick)]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        length = np.linalg.norm(sums, axis=1)
        centres = sums[length > 0] / length[length > 0, None]
    return centres


def _sample(vectors: DataFrame, key: Sequence[str], sample: int) -> np.ndarray:
    """About `sample` vectors, chosen by a hash of their keys, or all if there are no more."""
    n, fine = vectors.count(), 1 << 40
    if n > sample:
        vectors = vectors.filter(F.pmod(F.xxhash64(*key), F.lit(fine)) < int(fine * (sample / n)))
    return np.array([row["vec"] for row in vectors.select("vec").toLocalIterator()], dtype=np.float64)


def _placed(centres: np.ndarray):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def placed(vec: pa.Array) -> pa.Array:
        rows = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
        cosine = (rows @ centres.T) / np.linalg.norm(rows, axis=1, keepdims=True)
        cell = cosine.argmax(axis=1)
        angle = np.arccos(np.clip(cosine[np.arange(len(rows)), cell], -1, 1))
        offsets = np.arange(len(vec) + 1, dtype=np.int32) * 2
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.stack([cell, angle], axis=1).reshape(-1)))

    return placed


def store_cells(
    vectors: DataFrame, path: str, dim: int, cells: int = CELLS, key: Sequence[str] = CHUNK_KEY, sample: int = SAMPLE
) -> None:
    """Assign every vector of `vectors` (key, vec, any other columns) to a cell and store it there.

    The centres come from about `sample` vectors, chosen by a hash of their keys; all rows are assigned. NULL and zero
    vectors are left out, since no search returns them. `vectors` is read three times: pass a stored table. The write asks
    for a rebalance by cell, so a cell that holds a third of all rows is written by several tasks.
    """
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"cells must be between 1 and {MOST_CELLS}")
    spark = vectors.sparkSession
    usable = vectors.filter(F.col("vec").isNotNull()).withColumn("vec", checked(F.col("vec"), dim)).filter(nonzero("vec"))
    rows = _sample(usable, key, sample)
    centres = fit_centres(rows, cells) if len(rows) else np.eye(1, dim)
    place = usable.withColumn("_place", _placed(centres)(F.col("vec")))
    stored = place.withColumns({"angle": F.get("_place", 1), "cell": F.get("_place", 0).cast("int")}).drop("_place")
    stored.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    stats = spark.read.schema(stored.schema).parquet(path).groupBy("cell").agg(F.max("angle").alias("reach"), F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(centres)], "cell int, centre array<double>")
    names.join(stats, "cell").coalesce(1).write.mode("overwrite").parquet(cells_path(path))
    if not len(rows):  # a folder without files would have no schema
        stored.limit(0).write.mode("overwrite").parquet(path)


def cells_path(path: str) -> str:
    return f"{path.rstrip('/')}.cells"


def read_cells(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers, centres, reaches and sizes; at most MOST_CELLS rows."""
    rows = spark.read.parquet(cells_path(path)).orderBy("cell").collect()
    centres = np.array([row["centre"] for row in rows], dtype=np.float64)
    cell, reach, n = (np.array([row[c] for row in rows]) for c in ("cell", "reach", "n"))
    return cell.astype(np.int64), centres, reach.astype(np.float64), n.astype(np.int64)
