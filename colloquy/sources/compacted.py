"""The latest versions of all utterances as a table of their own, so that a view need not read every version ever landed.

The table is partitioned by (version, bucket). Compaction merges the log's new batches into the buckets they touch, writes those
under a new version, and publishes last which version of each bucket counts and up to which batch of each stream
the log is in it. Until then readers see the version before, and the log from that version's batches on: every reader
gets the same answer before, during and after a compaction. A job that died is run again.

Withdrawals, utterances whose latest text is NULL or empty, stay as rows: an older version that lands late must not return.
Records without a key or that could not be parsed stay in the log alone.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.prepare import current
from colloquy.schemas import LOG, UTTERANCE_KEY
from colloquy.sources.transcripts import quarantine

BATCHED = T.StructType(
    [*LOG.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
)
VERSION = ("file_mtime", "source_file", "role", "text")
STATE = "publication bigint, bucket int, version bigint, stream string, batch bigint"


def read_batched_log(spark: SparkSession, log: str) -> DataFrame:
    """The log as `streaming.upkeep` writes it."""
    return spark.read.schema(BATCHED).parquet(log)


def _published(spark: SparkSession, path: str) -> tuple[int, dict[int, int], dict[str, int]]:
    """The last publication's number, the version of each bucket, and the batch of each stream it reaches."""
    try:
        state = spark.read.schema(STATE).parquet(f"{path.rstrip('/')}.published")
        last = state.agg(F.max("publication")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return 0, {}, {}
    rows = state.filter(F.col("publication") == last).collect()  # one row per bucket and per stream
    versions = {row["bucket"]: row["version"] for row in rows if row["bucket"] is not None}
    return last, versions, {row["stream"]: row["batch"] for row in rows if row["stream"] is not None}


def _after(reached: dict[str, int]) -> Column:
    """Whether a record of the log is of a batch beyond those reached; all of these columns are partitions."""
    known = F.lit(False)
    for stream, batch in sorted(reached.items()):
        known = known | ((F.col("stream") == stream) & (F.col("batch") <= batch))
    return ~known


def _compacted(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    kept = F.lit(False)
    for version in sorted(set(versions.values())):
        kept = kept | ((F.col("version") == version) & F.col("bucket").isin([b for b, v in versions.items() if v == version]))
    schema = T.StructType([f for f in LOG.fields if f.name in (*UTTERANCE_KEY, *VERSION)]).add("version", T.LongType()).add("bucket", T.IntegerType())
    return spark.read.schema(schema).parquet(path).filter(kept).drop("version")


def _versions(spark: SparkSession, log: str, path: str | None, buckets: list[int] | None, until: dict[str, int] | None = None) -> DataFrame:
    """Usable records that decide the current state of `buckets`: compacted ones and the log's tail."""
    _, versions, reached = _published(spark, path) if path else (0, {}, {})
    tail = read_batched_log(spark, log).filter(_after(reached))
    if until is not None:
        tail = tail.filter(~_after(until))
    if buckets is not None:
        tail = tail.filter(F.col("bucket").isin(buckets))
        versions = {bucket: version for bucket, version in versions.items() if bucket in set(buckets)}
    columns = [*UTTERANCE_KEY, *VERSION, "bucket"]
    rows = quarantine(tail)[0].select(*columns)
    return rows.unionByName(_compacted(spark, path, versions).select(*columns)) if versions else rows


def current_rows(spark: SparkSession, log: str, path: str | None = None, buckets: list[int] | None = None) -> DataFrame:
    """What `current` gives over all usable records of the log (of some buckets), read from the compacted table and the log's tail."""
    return current(_versions(spark, log, path, buckets))


def compact(spark: SparkSession, log: str, path: str, until: dict[str, int]) -> list[int]:
    """Take the log up to the batches `until` (`streaming.upkeep.marks`) into the compacted table; returns the buckets rewritten.

    Only one compaction may run at a time. Older versions of buckets are left where they are, for readers that began before.
    """
    publication, versions, reached = _published(spark, path)
    until = {stream: max(batch, reached.get(stream, batch)) for stream, batch in (reached | until).items()}
    if until == reached:
        return []
    new = read_batched_log(spark, log).filter(_after(reached)).filter(~_after(until))
    touched = sorted(row["bucket"] for row in quarantine(new)[0].select("bucket").distinct().collect())
    if touched:
        rows = _versions(spark, log, path, touched, until)
        # One version per key is kept before the shuffle, as in `current`.
        latest = rows.groupBy("bucket", *UTTERANCE_KEY).agg(F.max(F.struct(*VERSION)).alias("_v")).select("bucket", *UTTERANCE_KEY, "_v.*")
        latest = latest.withColumn("version", F.lit(publication + 1).cast("long")).hint("rebalance", "bucket")
        writer = latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("version", "bucket").parquet(path)
    versions |= {bucket: publication + 1 for bucket in touched}
    state = [(publication + 1, bucket, version, None, None) for bucket, version in versions.items()]
    state += [(publication + 1, None, None, stream, batch) for stream, batch in until.items()]
    spark.createDataFrame(state, STATE).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}.published")
    return touched
