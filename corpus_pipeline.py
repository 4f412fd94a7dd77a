"""From raw documents to packed training sequences, stage by stage.

STAGES holds (name, function); each function takes (spark, docs, sf_dir), works on all rows of
`docs` and, but for the last, returns the columns of `docs`. `run` writes the rows of every
stage as Parquet in the shared folder and reads them again for the next.

Columns of `docs` other than those a stage reads are carried along under names of their own, so
they cannot clash with what an operator adds. Rows without a doc_id stay; empty tables pass.
"""

from __future__ import annotations

from collections.abc import Callable

from colloquy.llm import mixing, near_dedup, packing, quality, toxicity  # isort: skip  first: where it is missing, nothing else is asked for

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
READ = ("doc_id", "text", "lang", "source")


def _apart(docs: DataFrame) -> DataFrame:
    """The columns that stages read keep their names, all others get numbers."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"_own{i}") for i, c in enumerate(docs.columns)])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c if c in READ else f"_own{i}").alias(c) for i, c in enumerate(docs.columns)])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, fitted on the labelled documents: those predicted toxic go."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return _back(toxicity.score(_apart(docs), model, limit=0.3).where("predicted = 0"), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the base rules or their language's cutoff reject go."""
    scored = materialise(quality.features(_apart(docs)), "quality-features")  # read twice, made once
    thresholds = quality.learn(scored, _labels(spark, sf_dir), "lang", risk=0.05, doubt=0.05)
    return _back(quality.judge(scored, thresholds, "lang").where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of documents that are similar by 0.8 or more over shingles of five words, the smallest doc_id stays.

    A row without doc_id stays only where its whole group has none; of rows that share the smallest doc_id the one with
    the smallest digest of its text stays. Rows of one doc_id with equal texts are one, texts without words too.
    """
    keyed = materialise(_apart(docs).withColumn("_key", F.monotonically_increasing_id()), "near-copies-keyed")  # numbered once, in a table
    found = near_dedup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), percent=80)
    names = keyed.select("_key", F.col("doc_id").alias("_id"), F.md5("text").alias("_digest"))
    group = found.select(F.col("doc_id").alias("_key"), "component_id").join(names, "_key")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_digest", "_key")).alias("first")
    kept = group.groupBy("component_id").agg(first).select("first._id", "first._digest", "first._key")
    kept = kept.groupBy("_id", "_digest").agg(F.min("_key").alias("_key")).select("_key")
    return _back(keyed.join(kept, "_key", "left_semi"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document as often as the mix takes it."""
    mixed = mixing.mix(_apart(docs), weights=(3, 1, 2), share=1.5, cap=2).where("copies > 0")
    return _back(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents' pieces in sequences of 1024 tokens."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), room=1024, end=2)
    return packing.pack(cut, room=1024)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Learnt lexicons and thresholds, sketches and token pieces cannot be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
