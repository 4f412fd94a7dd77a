"""Plans and skew: what must hold on large tables, checked on small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import context, dense, encode, prepare, sparse
from colloquy.plans import queries
from colloquy.session import measure, spread
from colloquy.sources.transcripts import read_transcripts

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one meeting, and a third copies of one text in others."""
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) % 500)
    rows = [(7, t, "user", text()) for t in range(1000)]
    rows += [(1000 + i, 0, "user", "the same copied text") for i in range(1000)]
    rows += [(5000 + i // 5, i % 5, "assistant", text()) for i in range(1000)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6).cache()


def test_scan_is_pruned_and_filtered(spark):
    df = read_transcripts(spark, f"{SF}/conversations.parquet", origin=False).filter("conv_id = 5").select("turn")
    text = df._jdf.queryExecution().executedPlan().treeString()
    assert "PushedFilters: [IsNotNull(conv_id), EqualTo(conv_id,5)]" in text
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint>" in text


def test_small_scans_are_spread_and_large_ones_left_alone(spark):
    few = read_transcripts(spark, f"{SF}/conversations.parquet", origin=False)
    assert spread(few, "conv_id").rdd.getNumPartitions() == 8
    many = spark.range(100, numPartitions=9)
    assert spread(many) is many


def test_hot_meeting_is_spread_over_partitions(skewed):
    parts = prepare.by_utterance(skewed).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 2 * 3000 / 8


def test_partitions_follow_the_number_of_words(spark, skewed, monkeypatch):
    stats = encode.corpus_stats(prepare.chunk(skewed))
    assert stats.tasks() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(encode, "WORDS_PER_TASK", 1000)
    assert stats.tasks() == -(-stats.n_words // 1000) > 8


def test_no_shuffle_in_dense_encoders(spark, skewed):
    units = prepare.chunk(skewed)
    assert "Exchange" not in plan(encode.hash_vectors(units.drop("role"))).split("InMemoryRelation")[0]
    assert "Exchange" not in plan(encode.encode(units, queries.letter_model("ab"), 2, "x")).split("InMemoryRelation")[0]


def test_search_shuffles_only_hits(spark, skewed):
    units = prepare.chunk(skewed)
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "the same text")], "req_id long, text string")
    vectors = encode.hash_vectors(asked, 64)
    stats = encode.corpus_stats(units)
    for hits in (
        dense.semantic_search(vectors, encode.hash_vectors(units, 64), 5),
        dense.lsh_search(vectors, encode.hash_vectors(units, 64), 5, 64),
        sparse.bm25_search(asked, units, 5, stats),
    ):
        text = plan(hits).split("InMemoryRelation")[0]
        # Ranked per request and salt, then per request: both exchanges carry the best rows of their tasks alone.
        assert text.count("Exchange hashpartitioning") == 2
        assert "Exchange hashpartitioning(req_id" in text
        assert "WindowGroupLimit" in text


def test_copies_tie_and_are_ranked_by_key(spark, skewed):
    units = prepare.chunk(skewed)
    asked = spark.createDataFrame([(1, "the same copied text")], "req_id long, text string")
    stats = encode.corpus_stats(units)
    expected = [(1000 + i, 0, 0) for i in range(5)]
    for hits in (
        dense.semantic_search(encode.hash_vectors(asked), encode.hash_vectors(units), 5),
        dense.lsh_search(encode.hash_vectors(asked), encode.hash_vectors(units), 5, 256),
        sparse.term_search(encode.tfidf_requests(asked, stats), encode.tfidf_rows(units, stats), 5),
        sparse.bm25_search(asked, units, 5, stats),
    ):
        rows = sorted(hits.collect(), key=lambda r: r["rank"])
        assert [(r["conv_id"], r["turn"], r["chunk"]) for r in rows] == expected
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]


def test_hot_meeting_in_spans_equals_one_window(skewed):
    whole = context.neighbours(skewed, 2)
    spans = context.neighbours(skewed, 2, span=64)
    assert whole.count() == 3000
    assert spans.exceptAll(whole).count() == whole.exceptAll(spans).count() == 0


def test_measure_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([(1, "ab", [1.0, 2.0], ["x"]), (2, None, None, None)], "a long, b string, c array<double>, d array<string>")
    size = measure(df)
    assert size.rows == 2
    assert size.bytes == (8 + 18 + 32 + 33) + (8 + 16 + 16 + 16)

