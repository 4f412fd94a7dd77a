"""Filling and refreshing a vector store from the log."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.prepare import chunk, current
from colloquy.sources.transcripts import quarantine, read_log
from colloquy.session import materialise
from colloquy.sources.vector_store import BUCKETS, bucket_of, store_vectors

Encoder = Callable[[DataFrame], DataFrame]


def build_store(log: DataFrame, encoder: Encoder, path: str, dim: int, buckets: int = BUCKETS) -> None:
    """Encode the current text of every meeting in `log`, store it, and keep the list of its files."""
    files = materialise(log.select("source_file", "file_mtime").distinct(), "files")
    good, _ = quarantine(log)
    store_vectors(encoder(chunk(current(good))), path, dim, buckets)
    files.write.mode("overwrite").parquet(_taken(path))


def _taken(path: str) -> str:
    """Where the list of export files that a store was built from lies: a table next to it."""
    return f"{path.rstrip('/')}.files"


def _new_files(log: DataFrame, path: str) -> DataFrame:
    """(source_file, file_mtime, bucket) of records from files that the store does not have yet, as a written table.

    Times tell which version wins, not what has been stored: a file may land late with an old time.
    """
    files = log.select("source_file", "file_mtime", "bucket").distinct()
    known = log.sparkSession.read.parquet(_taken(path)).distinct()
    return materialise(files.join(known, ["source_file", "file_mtime"], "left_anti"), "new-files")


def rebuild(utterances: DataFrame, changed: list[int], encoder: Encoder, path: str, dim: int, buckets: int = BUCKETS) -> None:
    """Replace the buckets `changed`, all of whose current utterances are given. A bucket without text is emptied."""
    vectors = materialise(encoder(chunk(utterances)), "refreshed")
    full = {row["b"] for row in vectors.select(bucket_of(F.col("conv_id"), buckets).alias("b")).distinct().collect()}
    store_vectors(vectors, path, dim, buckets)
    for bucket in changed:
        if bucket not in full:  # dynamic overwriting of rows cannot replace a partition by nothing
            vectors.limit(0).write.mode("overwrite").parquet(f"{path}/bucket={bucket}")


def refresh_store(
    spark: SparkSession, log_path: str, encoder: Encoder, path: str, dim: int, buckets: int = BUCKETS
) -> list[int]:
    """Rebuild the buckets that have records from files not stored yet. Each is rebuilt whole, as writing it replaces it.

    A bucket whose meetings have lost all their text is emptied.

    Log and store share their buckets, so only the changed partitions are read.
    Not for encoders that depend on the whole corpus: build those anew.
    """
    log = read_log(spark, log_path)
    files = _new_files(log, path)
    changed = sorted(row["bucket"] for row in files.select("bucket").distinct().collect())  # no more than there are buckets
    if changed:
        good, _ = quarantine(log.filter(F.col("bucket").isin(changed)))
        rebuild(current(good), changed, encoder, path, dim, buckets)
        files.select("source_file", "file_mtime").distinct().write.mode("append").parquet(_taken(path))
    return changed
