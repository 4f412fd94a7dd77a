"""Conditions of requests, and ranks.

Every search scores in double, ranks on the score rounded to 9 digits and then on
the key, and reports the score rounded to 6. A request may carry conditions
(schemas.REQUEST_FILTERS); they are applied before ranking, since a filter after
it would leave fewer than k hits.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.inside import PLACES
from colloquy.operators.joins import SALTS, join_small
from colloquy.sources.vector_store import in_buckets

MOST_ROLES = 1_000  # roles that one filter lists


def restrict(units: DataFrame, conv_ids=None, roles=None) -> DataFrame:
    """Keep the units of some meetings and speakers, each given as a list or as a one-column table.

    Lists become filters that reach the scan; tables become semi joins.
    """
    for column, wanted in (("conv_id", conv_ids), ("role", roles)):
        if wanted is None:
            continue
        if isinstance(wanted, DataFrame):
            keys = wanted.toDF(column).distinct()
            units = join_small(units, keys, [column], spread_by=[c for c in units.columns if c != column], how="left_semi")
        else:
            units = units.filter(F.col(column).isin(list(wanted)))
    return units


def restrict_to(requests: DataFrame, units: DataFrame, buckets: int | None = None) -> DataFrame:
    """Leave out units that no request admits, before they are encoded or read.

    Where every request names meetings or speakers, the union of what they name is kept:
    meetings by a semi join (and, with `buckets`, by the store's partitions), speakers by a filter
    that reaches the scan.
    """
    if "conv_ids" in requests.columns and requests.filter("conv_ids IS NULL").isEmpty():
        met = requests.select(F.explode("conv_ids").alias("conv_id")).distinct()
        if buckets and "bucket" in units.columns:
            units = units.filter(in_buckets(met, buckets))
        units = restrict(units, conv_ids=met)
    if "roles" in requests.columns and requests.filter("roles IS NULL").isEmpty():
        named = requests.select(F.explode("roles").alias("r")).distinct().limit(MOST_ROLES + 1).collect()
        if len(named) <= MOST_ROLES:  # the search tests roles again, so no filter is right too
            units = restrict(units, roles=[row["r"] for row in named])
    return units


def admitted(columns: Sequence[str]) -> Column:
    """Whether the unit in a row meets the conditions of the request in the same row."""
    ok = F.lit(True)
    if "conv_ids" in columns:
        ok = ok & (F.col("conv_ids").isNull() | F.array_contains("conv_ids", F.col("conv_id")))
    if "roles" in columns:
        ok = ok & (F.col("roles").isNull() | F.array_contains("roles", F.col("role")))
    if "exclude_conv" in columns:
        ok = ok & (F.col("exclude_conv").isNull() | (F.col("exclude_conv") != F.col("conv_id")))
    return ok


def largest_k(requests: DataFrame, k: int) -> int:
    """The largest number of hits any request asks for."""
    if "k" not in requests.columns:
        return k
    return max(k, requests.agg(F.max("k")).first()[0] or 0)


def rank_hits(scored: DataFrame, key: Sequence[str], k: int, limit: int | None = None) -> DataFrame:
    """The best rows per request. `limit` bounds k where requests bring their own.

    With a constant bound on the rank Spark keeps at most that many rows per
    request in each task before it shuffles. The rows of all tasks are ranked per
    request and salt first, so that one request over many tasks is not one sort.
    """
    order = [F.round("score", PLACES).desc(), *key]
    best, part = Window.partitionBy("req_id").orderBy(*order), Window.partitionBy("req_id", "_salt").orderBy(*order)
    ranked = (
        scored.filter(F.col("score").isNotNull())
        .withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)))
        .withColumn("_first", F.row_number().over(part))
        .filter(F.col("_first") <= (limit or k))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= (limit or k))
    )
    if "k" in scored.columns:
        ranked = ranked.filter(F.col("rank") <= F.coalesce("k", F.lit(k)))
    return ranked.select("req_id", *key, "rank", F.round("score", 6).alias("score"))
