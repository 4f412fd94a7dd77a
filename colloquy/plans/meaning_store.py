"""Passages stored by meaning: a versioned model next to the vectors, kept up by what has changed.

Under `path` lie
    model/version=v   counts (operators.meaning.MODEL) that version v adds to those before it; a
                      correction subtracts what the old text had counted and adds the new text's
    words/version=v   (term, df, n_words, at, n): the entries of vectors and the frequencies of all words at version v
    vectors/context-v the chunk vectors, a bucketed store whose `encoder` is context-v
    files/version=v   the export files that version v has taken in
    published         a row per version that is complete, with `dim` and `buckets`
    withdrawn         a row per version that is no longer to be searched
A version is published last, so a search never meets a half-written one, and a job that died is run
again under the same number. Older versions stay readable until `forget` drops them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.dense import semantic_search
from colloquy.operators.encode import CorpusStats
from colloquy.operators.meaning import DIM, MODEL, meaning_requests, meaning_vectors, model_change, model_counts, words_of
from colloquy.operators.prepare import chunk, current
from colloquy.schemas import UTTERANCE_KEY
from colloquy.session import materialise
from colloquy.sources.transcripts import quarantine, read_log
from colloquy.sources.vector_store import BUCKETS, read_vectors, store_vectors

_PUBLISHED = "version int, dim int, buckets int"


def encoder_of(version: int) -> str:
    return f"context-{version}"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _drop(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def _listed(spark: SparkSession, path: str) -> set[int]:
    files, where = _folder(spark, path)
    if not files.exists(where):
        return set()
    return {row["version"] for row in spark.read.schema(_PUBLISHED).parquet(path).select("version").collect()}  # a row per build or refresh


def _note(spark: SparkSession, path: str, rows: list[tuple[int, int, int]]) -> None:
    spark.createDataFrame(rows, _PUBLISHED).coalesce(1).write.mode("append").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order."""
    return sorted(_listed(spark, f"{path}/published") - _listed(spark, f"{path}/withdrawn"))


def _settings(spark: SparkSession, path: str, version: int) -> tuple[int, int]:
    rows = spark.read.schema(_PUBLISHED).parquet(f"{path}/published").filter(F.col("version") == version)
    row = rows.first()
    return row["dim"], row["buckets"]


def _utterances(log: DataFrame) -> DataFrame:
    good, _ = quarantine(log)
    return current(good)


def _changes(log: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Utterances as they were when only the files `taken` had arrived, and as they are, where the two differ."""
    old = _utterances(log.join(taken, ["source_file", "file_mtime"], "left_semi")).select(*UTTERANCE_KEY, F.col("role").alias("_r"), F.col("text").alias("_t"))
    both = _utterances(log).join(old, list(UTTERANCE_KEY), "full").filter(~F.col("text").eqNullSafe(F.col("_t")))
    both = materialise(both, "changed")
    return both.select(*UTTERANCE_KEY, F.col("_r").alias("role"), F.col("_t").alias("text")), both.select(*UTTERANCE_KEY, "role", "text")


def _publish(spark: SparkSession, log: DataFrame, path: str, version: int, counts: DataFrame, files: DataFrame, dim: int, buckets: int) -> int:
    counts.write.mode("overwrite").parquet(f"{path}/model/version={version}")
    model = spark.read.schema(T.StructType([*MODEL.fields, T.StructField("version", T.IntegerType())])).parquet(f"{path}/model").filter(F.col("version") <= version)
    words_of(model).write.mode("overwrite").parquet(f"{path}/words/version={version}")
    stats, vectors = read_model(spark, path, version)
    made = meaning_vectors(chunk(_utterances(log)), stats, vectors, dim)
    made = made.withColumns({"encoder": F.lit(encoder_of(version)), "dim": F.lit(dim)})
    _drop(spark, f"{path}/vectors/{encoder_of(version)}")  # what a job that died has left
    store_vectors(made, f"{path}/vectors/{encoder_of(version)}", dim, buckets)
    files.write.mode("overwrite").parquet(f"{path}/files/version={version}")
    _note(spark, f"{path}/published", [(version, dim, buckets)])
    return version


def build_meaning_store(spark: SparkSession, log_path: str, path: str, dim: int = DIM, buckets: int = BUCKETS) -> int:
    """Learn from all of the log, store its passages, and publish both as version 1."""
    if versions(spark, path):
        raise ValueError(f"{path} has published versions: refresh it, or build elsewhere")
    log = read_log(spark, log_path)
    files = materialise(log.select("source_file", "file_mtime").distinct(), "files")
    rows = _utterances(log)
    return _publish(spark, log, path, 1, model_counts(rows, chunk(rows), dim), files, dim, buckets)


def refresh_meaning(spark: SparkSession, log_path: str, path: str) -> int:
    """Take in files that have landed since. Returns the version that is current then: the same if there are none.

    Only buckets with new files are compared, and only utterances that have changed are counted: their old counts are
    taken back, their new ones added. All weights depend on the whole corpus, so a new version encodes all passages again.
    """
    known = versions(spark, path)
    if not known:
        raise ValueError(f"{path} has no published version to refresh")
    dim, buckets = _settings(spark, path, known[-1])
    log = read_log(spark, log_path)
    arrived = log.select("source_file", "file_mtime", "bucket").distinct()
    taken = spark.read.parquet(f"{path}/files").filter(F.col("version") <= known[-1]).select("source_file", "file_mtime").distinct()
    new = materialise(arrived.join(taken, ["source_file", "file_mtime"], "left_anti"), "new-files")
    touched = sorted(row["bucket"] for row in new.select("bucket").distinct().collect())  # no more than there are buckets
    if not touched:
        return known[-1]
    was, is_now = _changes(log.filter(F.col("bucket").isin(touched)), taken)
    delta = model_change((was, chunk(was)), (is_now, chunk(is_now)), dim)
    return _publish(spark, log, path, known[-1] + 1, delta, new.select("source_file", "file_mtime").distinct(), dim, buckets)


def read_model(spark: SparkSession, path: str, version: int) -> tuple[CorpusStats, DataFrame]:
    """Frequencies and word vectors of a version."""
    words = spark.read.parquet(f"{path}/words/version={version}")
    total = words.filter("term IS NULL").first()
    stats = CorpusStats(words.filter("term IS NOT NULL AND df > 0").select("term", "df"), total["df"] if total else 0, total["n_words"] if total else 0)
    return stats, words.filter("term IS NOT NULL").select("term", "df", "at", "n")


def _version(spark: SparkSession, path: str, version: int | None) -> int:
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"version {version or 'any'} is not published at {path}; published are {known}")
    return known[-1] if version is None else version


def encode_requests(spark: SparkSession, requests: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """Text requests as vectors of a store's version, the latest if none is named; a written table with that `encoder`."""
    version = _version(spark, path, version)
    dim, _ = _settings(spark, path, version)
    stats, vectors = read_model(spark, path, version)
    asked = meaning_requests(requests, stats, vectors, dim)
    return materialise(asked.withColumn("encoder", F.lit(encoder_of(version))), "requests")


def search_meaning(spark: SparkSession, asked: DataFrame, path: str, k: int, version: int | None = None) -> DataFrame:
    """Hits of encoded requests over a store's version. Requests encoded with another version are an error, not a bad answer."""
    version = _version(spark, path, version)
    other = asked.filter(~F.col("encoder").eqNullSafe(F.lit(encoder_of(version)))).first()
    if other is not None:
        raise ValueError(f"requests are encoded by {other['encoder']}, the store asked is {encoder_of(version)}")
    _, buckets = _settings(spark, path, version)
    stored = read_vectors(spark, f"{path}/vectors/{encoder_of(version)}", encoder_of(version), buckets=buckets)
    return semantic_search(asked.drop("encoder"), stored, k, buckets=buckets)


def stored_meaning_hits(spark: SparkSession, requests: DataFrame, path: str, k: int, version: int | None = None) -> DataFrame:
    """Hits of text requests by meaning, from the store alone: no transcript is read."""
    return search_meaning(spark, encode_requests(spark, requests, path, version), path, k, version)


def forget(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Drop the vectors and words of all published versions but the last `keep`; counts stay, as later versions add to them."""
    known = versions(spark, path)
    gone = known[: max(0, len(known) - keep)]
    if gone:
        _note(spark, f"{path}/withdrawn", [(version, *_settings(spark, path, version)) for version in gone])
    for version in gone:
        _drop(spark, f"{path}/vectors/{encoder_of(version)}")
        _drop(spark, f"{path}/words/version={version}")
    return gone
