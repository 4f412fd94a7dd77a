"""The vector store: Parquet, partitioned by a bucket of the meeting.

A bucket is the unit of replacement, so a store must be read and written with
one and the same number of buckets.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.vectors import checked
from colloquy.operators.joins import join_small

BUCKETS = 64


def bucket_of(conv_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(conv_id), F.lit(buckets)).cast("int")


def store_vectors(vectors: DataFrame, path: str, dim: int, buckets: int = BUCKETS) -> None:
    """Write vectors; a bucket that occurs in `vectors` is replaced as a whole, others stay.

    The rebalance hint lets adaptive execution gather each bucket into files of
    the advisory size: small buckets are not scattered over every task, and a
    bucket blown up by one long meeting is split over many.
    """
    out = vectors.withColumn("vec", checked(F.col("vec"), dim))
    (
        out.withColumn("bucket", bucket_of(F.col("conv_id"), buckets))
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_vectors(
    spark: SparkSession,
    path: str,
    encoder: str,
    conv_ids: Sequence[int] | DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Vectors of one encoder; naming meetings, as a list or a table of conv_id, prunes the scan to their buckets."""
    stored = spark.read.parquet(path).filter(F.col("encoder") == encoder)
    if conv_ids is None:
        return stored
    if not isinstance(conv_ids, DataFrame):
        conv_ids = spark.createDataFrame([(int(c),) for c in conv_ids], "conv_id long")
    wanted = conv_ids.select("conv_id").filter("conv_id IS NOT NULL").distinct()
    return join_small(stored.filter(in_buckets(wanted, buckets)), wanted, ["conv_id"], spread_by=["turn"], how="left_semi")


def in_buckets(meetings: DataFrame, buckets: int) -> Column:
    """Whether a row lies in a bucket of one of the meetings; the list is no longer than the number of buckets."""
    rows = meetings.select(bucket_of(F.col("conv_id"), buckets).alias("b")).distinct().collect()
    return F.col("bucket").isin(sorted(row["b"] for row in rows))
