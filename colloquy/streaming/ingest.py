"""Continuous ingest: new export files are appended to the log, each exactly once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.schemas import CORRUPT
from colloquy.sources.transcripts import export_reader, with_origin
from colloquy.sources.vector_store import BUCKETS, bucket_of

BATCH = 64 * 1024**3  # bytes of a micro-batch
EVER = "3650000d"  # longer before the newest file than any time a file system can state


def landing(
    spark: SparkSession, source: str, format: str, buckets: int, max_files: int | None, max_file_age: str, max_bytes: int
) -> DataFrame:
    """The stream of new records in the log schema, with their bucket."""
    reader = export_reader(spark.readStream, format).option("maxFileAge", max_file_age)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    rows = with_origin(reader.load(source))
    # Records without a meeting are put aside later; until then they are spread, not heaped in one bucket.
    own = F.xxhash64("turn", "role", "text", CORRUPT, "source_file")
    bucket = F.when(F.col("conv_id").isNull(), F.pmod(own, F.lit(buckets)).cast("int")).otherwise(bucket_of(F.col("conv_id"), buckets))
    return rows.withColumn("bucket", bucket)


def ingest_stream(
    spark: SparkSession,
    source: str,
    log: str,
    checkpoint: str,
    format: str = "json",
    buckets: int = BUCKETS,
    max_files_per_trigger: int | None = None,
    interval: str | None = None,
    max_file_age: str = EVER,
    max_bytes_per_trigger: int = BATCH,
) -> StreamingQuery:
    """Append the files in the folder `source` that the checkpoint has not seen to the log.

    Files count as new whatever time they carry: the stream remembers all names it has seen, or with a shorter
    `max_file_age` those of that period, and then files that are older yet never arrive. Without `interval`
    it takes what is there and ends, in micro-batches of `max_bytes_per_trigger` (or of so many files); with
    one ("1 minute") it keeps running. Nothing is dropped here: a corrected transcript is a later
    version, and `current` picks it. A stateful de-duplication would keep the old
    text, and its state would grow for ever. The log is partitioned like the
    vector store, so that replacing a bucket reads only that bucket.
    """
    rows = landing(spark, source, format, buckets, max_files_per_trigger, max_file_age, max_bytes_per_trigger)
    # Adaptive execution gathers small buckets and cuts large ones, by the bytes of the micro-batch: small exports make few files, and
    # a long meeting is written by several tasks.
    rows = rows.hint("rebalance", "bucket")
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("bucket")
        .option("path", log)
        .option("checkpointLocation", checkpoint)
    )
    if interval:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
