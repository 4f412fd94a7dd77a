"""From landing to store in one stream: every micro-batch is logged, stored and marked as done, in that order.

The log is partitioned by (stream, batch, bucket), where `stream` is the id that Spark keeps in the checkpoint. A batch
that is repeated after a failure replaces its own partitions and rebuilds the same buckets, so it changes nothing; one
that is marked as done is passed over. A new checkpoint is a new stream and never overwrites what an older one has logged.
"""

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.plans.store import Encoder, rebuild
from colloquy.sources.compacted import current_rows
from colloquy.sources.vector_store import BUCKETS
from colloquy.streaming.ingest import BATCH, EVER, landing

Then = Callable[[SparkSession, list[int]], None]
MARKS = "stream string, batch bigint"


def marks(spark: SparkSession, log: str) -> dict[str, int]:
    """The last batch of each stream that is logged and has been followed up; a stream is one checkpoint."""
    try:
        rows = spark.read.schema(MARKS).parquet(_marks_path(log)).groupBy("stream").agg(F.max("batch").alias("batch")).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {row["stream"]: row["batch"] for row in rows}


def _marks_path(log: str) -> str:
    return f"{log.rstrip('/')}.marks"


def follow(
    spark: SparkSession,
    source: str,
    log: str,
    checkpoint: str,
    then: Then | None = None,
    format: str = "json",
    buckets: int = BUCKETS,
    interval: str | None = None,
    max_files_per_trigger: int | None = None,
    max_file_age: str = EVER,
    max_bytes_per_trigger: int = BATCH,
) -> StreamingQuery:
    """Log new exports as `ingest_stream` does, and call `then(session, touched buckets)` after each micro-batch.

    `then` must give the same result when called twice: after a failure it is. The mark of a stream is one row that is
    replaced; if it is lost the batch is done again. A micro-batch without records is only marked.
    """
    rows = landing(spark, source, format, buckets, max_files_per_trigger, max_file_age, max_bytes_per_trigger)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stream = json.loads(session.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        if marks(session, log).get(stream, -1) >= number:
            return
        own = batch.withColumns({"stream": F.lit(stream), "batch": F.lit(number).cast("long")}).hint("rebalance", "bucket")
        writer = own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("stream", "batch", "bucket").parquet(log)
        part = session.read.schema(own.schema).parquet(log).filter((F.col("stream") == stream) & (F.col("batch") == number))
        touched = sorted(row["bucket"] for row in part.select("bucket").distinct().collect())  # no more than there are buckets
        if then and touched:
            then(session, touched)
        mark = session.createDataFrame([(stream, number)], MARKS).coalesce(1)
        mark.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream").parquet(_marks_path(log))

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_to_store(
    spark: SparkSession,
    source: str,
    log: str,
    checkpoint: str,
    encoder: Encoder,
    path: str,
    dim: int,
    buckets: int = BUCKETS,
    compacted: str | None = None,
    **options,
) -> StreamingQuery:
    """Keep a vector store up with the exports that land: each micro-batch rebuilds the buckets it touched.

    A bucket is rebuilt from its part of the log, or of `compacted` (`sources.compacted`) and the log's tail. For encoders whose
    vectors do not depend on the whole corpus. `options` are those of `follow`.
    """

    def store(session: SparkSession, touched: list[int]) -> None:
        rebuild(current_rows(session, log, compacted, touched), touched, encoder, path, dim, buckets)

    return follow(spark, source, log, checkpoint, store, buckets=buckets, **options)
