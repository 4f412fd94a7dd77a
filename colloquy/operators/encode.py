"""Encoders: from text units to sparse (TF-IDF) or dense vectors.

TF-IDF and feature hashing are lexical: they match words, not meaning. Context
vectors (operators.meaning) and a model passed to `encode` go beyond shared words.
"""

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import term_counts, words
from colloquy.functions.vectors import checked, norm
from colloquy.operators import inside
from colloquy.operators.joins import join_small
from colloquy.operators.prepare import by_utterance, terms
from colloquy.schemas import CHUNK_KEY, REQUEST_FILTERS
from colloquy.session import BROADCAST_BYTES, BROADCAST_ROWS, Size, materialise, measure


# --- corpus statistics ---------------------------------------------------------------

# How finely a corpus is cut for work on its terms: tasks of about this many words.
WORDS_PER_TASK = 5_000_000
SMALL = Size(BROADCAST_ROWS, BROADCAST_BYTES)
HOT_WORDS = 50_000  # words at most that are sent to all tasks where the vocabulary is not


@dataclass(frozen=True)
class CorpusStats:
    """Document frequencies (term, df), the number of units, and their total length in words."""

    table: DataFrame
    n_units: int
    n_words: int

    def hot(self) -> DataFrame:
        """Words in so many units that there can be no more than HOT_WORDS of them: their frequencies add up to `n_words` at most."""
        return self.table.filter(F.col("df") * HOT_WORDS >= self.n_words)

    def hot_df(self) -> int:
        """The frequency from which on words are hot."""
        return max(1, -(-self.n_words // HOT_WORDS))

    def tasks(self) -> int:
        """Partitions for work on all terms of the corpus: by its size, and at least one per core."""
        cores = self.table.sparkSession.sparkContext.defaultParallelism
        return max(cores, -(-self.n_words // WORDS_PER_TASK))


def corpus_stats(units: DataFrame) -> CorpusStats:
    """Count in one pass over the text and keep the counts as a written table.

    Each unit adds one row per distinct word and one row without a word, which
    counts the unit. All are summed up before the shuffle, so what is shuffled is
    at most the vocabulary per task, however frequent a word is.
    """
    said = units.select(words(F.col("text")).alias("_words"))
    distinct = F.array_append(F.array_distinct("_words"), F.lit(None).cast("string"))
    rows = said.select(F.size("_words").alias("_n"), F.explode(F.when(F.size("_words") > 0, distinct)).alias("term"))
    counted = rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum(F.when(F.col("term").isNull(), F.col("_n"))).alias("n_words"),
    )
    table = materialise(counted, "corpus-stats")
    total = table.filter(F.col("term").isNull()).first()
    table = table.filter(F.col("term").isNotNull()).select("term", "df")
    return CorpusStats(table, total["df"] if total else 0, total["n_words"] if total else 0)


# --- TF-IDF --------------------------------------------------------------------------


def _tfidf_weight(n_units: int) -> Column:
    idf = F.log((F.lit(n_units) + 1) / (F.coalesce(F.col("df"), F.lit(0)) + 1)) + 1
    return (F.log("tf") + 1) * idf


def tfidf_rows(units: DataFrame, stats: CorpusStats, key: Sequence[str] = CHUNK_KEY, small: Size = SMALL) -> DataFrame:
    """Sparse unit vectors, one row per unit with `terms`, an array of (term, tf, weight).

    While the vocabulary is small enough to broadcast, the terms of a unit are weighted
    where they are: nothing is shuffled. Beyond that, the most frequent words are sent to
    all tasks, which leaves no hot key, all others meet the vocabulary in a join, and units
    are put together again.
    """
    rest = [c for c in units.columns if c != "text"]
    if measure(stats.table).within(small.rows, small.bytes):
        return _weighted_in_place(units, stats, rest)
    many = stats.hot()
    split = terms(by_utterance(units, stats.tasks()))
    hot = split.join(F.broadcast(many), "term")
    rare = stats.table.join(F.broadcast(many.select("term")), "term", "left_anti")
    cold = split.join(F.broadcast(many.select("term")), "term", "left_anti").join(rare.hint("shuffle_merge"), "term")
    weighted = hot.unionByName(cold).withColumn("weight", _tfidf_weight(stats.n_units))
    rows = weighted.groupBy(*key, *[c for c in rest if c not in key]).agg(
        F.collect_list(F.struct("term", "tf", "weight")).alias("terms"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"),
    )
    unit_length = lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf"), (t["weight"] / F.col("_length")).alias("weight"))
    return rows.select(*rest, F.transform("terms", unit_length).alias("terms"))


def _weighted_in_place(units: DataFrame, stats: CorpusStats, rest: list[str]) -> DataFrame:
    """The vocabulary, measured to be small, goes to all tasks; a batch's terms are looked up in it as one column."""
    shared = units.sparkSession.sparkContext.broadcast(stats.table.toArrow())
    n_units = stats.n_units
    counted = units.select(*rest, term_counts(F.col("text")).alias("terms"))
    schema = T.StructType([*[units.schema[c] for c in rest], T.StructField("terms", T.ArrayType(T.StructType([
        T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("weight", T.DoubleType()),
    ])))])

    places, whole = inside.make_places(), inside.make_whole()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = whole(shared.value.column("term"))
        df = shared.value.column("df").to_numpy()
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            lists = batch.column("terms")
            flat = lists.flatten()
            coded = flat.field("term").dictionary_encode()
            at = places(coded.dictionary, known)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            keep = at >= 0  # others are words of units that the statistics do not cover
            tf, row = flat.field("tf").to_numpy()[keep], row[keep]
            weight = (np.log(tf) + 1) * (np.log((n_units + 1) / (df[at[keep]] + 1)) + 1)
            length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=batch.num_rows))
            made = pa.StructArray.from_arrays(
                [flat.field("term").filter(pa.array(keep)), pa.array(tf), pa.array(weight / length[row])], names=["term", "tf", "weight"]
            )
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.ListArray.from_arrays(offsets, made)], names=[*rest, "terms"])
            yield out.filter(pc.greater(pc.list_value_length(out.column("terms")), 0))

    return counted.mapInArrow(weigh, schema)


def tfidf(units: DataFrame, stats: CorpusStats | None = None, key: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """Sparse unit vectors, one row per unit and term: (1 + ln tf) * (ln((N+1)/(df+1)) + 1), L2-normalised."""
    rest = [c for c in units.columns if c != "text"]
    return tfidf_rows(units, stats or corpus_stats(units), key).select(*rest, F.inline("terms"))


def request_terms(requests: DataFrame, stats: CorpusStats) -> DataFrame:
    """Words of each request with their count and document frequency (0 if unknown), as a written table."""
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    counted = requests.select("req_id", *filters, F.inline(term_counts(F.col("text"))))
    known = stats.table
    if measure(counted.select("req_id", "term")).within(BROADCAST_ROWS, BROADCAST_BYTES):
        # No larger than the table just measured, while the vocabulary may be.
        known = F.broadcast(known.join(F.broadcast(counted.select("term")), "term", "left_semi"))
        found = counted.join(known, "term", "left")
    else:
        found = join_small(counted, known, ["term"], spread_by=["req_id"], how="left")
    return materialise(found.fillna({"df": 0}), "request-terms")


def tfidf_requests(requests: DataFrame, stats: CorpusStats) -> DataFrame:
    """Requests as sparse unit vectors, weighted by the statistics of the store they are asked of."""
    weighted = request_terms(requests, stats).withColumn("weight", _tfidf_weight(stats.n_units))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("req_id")))
    return weighted.withColumn("weight", F.col("weight") / length).drop("df")


# --- dense vectors -------------------------------------------------------------------


def _vectors(df: DataFrame, encoder: str, dim: int) -> DataFrame:
    """Add the columns every dense vector table has."""
    return df.withColumns({"encoder": F.lit(encoder), "dim": F.lit(dim), "norm": norm(F.col("vec"))})


def hash_vectors(units: DataFrame, dim: int = 256) -> DataFrame:
    """Signed feature hashing: each word adds its count, with its sign, to its bucket.

    bucket = first 8 hex digits of the word's md5, modulo `dim`; the sign is + if the
    next 4 hex digits are even. Words are cut in the JVM; Arrow batches of them are
    hashed once per distinct word and summed up as arrays. Nothing is shuffled.
    """
    kept = [c for c in units.columns if c != "text"]
    cut = units.select(*kept, words(F.col("text")).alias("_words"))
    added = [T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("norm", T.DoubleType())]
    schema = T.StructType([*[units.schema[c] for c in kept], *added])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("_words")), 0))
            n = batch.num_rows
            lists = batch.column("_words")
            coded = lists.flatten().dictionary_encode()
            digests = [md5(word.encode()).hexdigest() for word in coded.dictionary.to_pylist()]
            bucket = np.array([int(d[:8], 16) % dim for d in digests], dtype=np.int64)
            sign = np.array([1.0 - 2 * (int(d[8:12], 16) % 2) for d in digests])
            at = coded.indices.to_numpy()
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            dense = np.bincount(row * dim + bucket[at], weights=sign[at], minlength=n * dim)
            norms = np.sqrt((dense.reshape(n, dim) ** 2).sum(axis=1))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
            vec = pa.ListArray.from_arrays(offsets, pa.array(dense.astype(np.float32)))
            columns = [*[batch.column(c) for c in kept], vec, pa.array(norms)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "vec", "norm"])

    filled = cut.mapInArrow(fill, schema)
    return filled.withColumns({"encoder": F.lit(f"hash-md5-{dim}"), "dim": F.lit(dim)})


Model = Callable[[list[str]], np.ndarray]


def encode(
    units: DataFrame,
    load: Callable[[], Model],
    dim: int,
    encoder: str,
    model_id: str | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Encode with the user's own model: `load()` gives a function from texts to a (n, dim) array.

    `load` runs once per task, or with a `model_id` once per Python worker: the worker keeps its last model for later tasks and
    queries that name the same id, so another model needs another id. Workers outlive a task where
    `spark.python.worker.reuse` is on, as it is by default. With a `profile` the encoding stage asks the cluster for its resources
    (accelerators, memory). A result of another shape, or a vector that is not, fails the job.
    """

    def model_of() -> Model:
        if model_id is None:
            return load()
        kept = sys.__dict__.setdefault("_colloquy_model", {})
        if model_id not in kept:
            kept.clear()  # a worker holds one model
            kept[model_id] = load()
        return kept[model_id]

    def vectors_of(model: Model, texts: pa.Array) -> pa.Array:
        made = np.asarray(model([text or "" for text in texts.to_pylist()]), dtype=np.float32).reshape(len(texts), -1)
        if made.shape[1] != dim or not np.isfinite(made).all():
            raise ValueError(f"model must give finite vectors of length {dim}, got shape {made.shape}")
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(made.reshape(-1)))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of()
        for texts in batches:
            yield vectors_of(model, texts)

    kept = [c for c in units.columns if c != "text"]

    def apply_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            columns = [*[batch.column(c) for c in kept], vectors_of(model, batch.column("text"))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "vec"])

    if profile is None:
        dense = units.withColumn("vec", apply(F.col("text"))).drop("text")
    else:
        schema = T.StructType([units.schema[c] for c in kept]).add("vec", T.ArrayType(T.FloatType()))
        dense = units.mapInArrow(apply_rows, schema, profile=profile)
    return _vectors(dense.withColumn("vec", checked(F.col("vec"), dim)), encoder, dim)
