"""Cuts by counting equal sorted ones, and columns named like an operator's own are kept."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import lm_score, quality, toxicity
from colloquy.llm.cuts import cut
from colloquy.session import materialise

INNER = (
    "_own0", "_own1", "_w", "_shouts", "_capitals", "_lines", "_stratum", "_of", "_cutoff", "_badness", "_failed", "_text", "_row", "_log",
    "_class", "_known", "_rare", "_times", "_rare_log", "_rare_known", "key", "t", "c", "cutoff", "stratum", "bound", "_hash", "_key", "_toxic", "mark",
)


def plain_cut(values, n):
    if len(values) <= n:
        return None
    edge = sorted(values)[max(n, 1) - 1]
    return edge, sum(v < edge for v in values)


@pytest.mark.parametrize("span", [3, 5000, 1 << 63])
def test_cut_is_the_nth_number(spark, span):
    rng = random.Random(span)
    values = [rng.randrange(-span, span) for _ in range(600)] + [-span, span - 1, 0, 0, 0]
    rows = materialise(spark.createDataFrame([(v,) for v in values], "v long").repartition(5), "values")
    for n in (1, 2, 300, len(values) - 1, len(values), len(values) + 1):
        assert cut(rows, "v", n) == plain_cut(values, n)
    assert cut(rows, "v", 0) == (min(values), 0)
    assert cut(rows.limit(0), "v", 3) is None


@pytest.mark.parametrize("n", [1, 7, 40, 400, 401])
def test_most_frequent_words_are_those_of_a_sort(spark, n):
    rng = random.Random(n)
    words = [(rng.randrange(-(1 << 63), 1 << 63), rng.choice([1, 1, 1, 2, 2, 3, 900, 70_000])) for _ in range(400)]
    table = materialise(spark.createDataFrame(words, "key long, c long"), "words")
    kept = lm_score._most_frequent(table, n)
    assert sorted(map(tuple, kept.collect())) == sorted(sorted(words, key=lambda w: (-w[1], w[0]))[:n])
    assert "TakeOrderedAndProject" not in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 5, 60, 61])
def test_labelled_rows_are_the_first_by_hash(spark, n):
    rows = [(i, i % 2, i // 4 * 1000 - 9000) for i in range(60)]  # four keys to a hash
    table = materialise(spark.createDataFrame(rows, "_key long, _toxic int, _hash long"), "labelled")
    kept = toxicity._first_by_hash(table, n)
    assert sorted(map(tuple, kept.collect())) == sorted((k, t) for k, t, _ in sorted(rows, key=lambda r: (r[2], r[0]))[:n])
    assert "TakeOrderedAndProject" not in kept._jdf.queryExecution().executedPlan().toString()


def named(docs):
    return docs.withColumns({name: F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")) for name in INNER})


def kept_as_given(rows):
    return all(r[name] == (None if r["doc_id"] is None else f"{name} {r['doc_id']}") for r in rows for name in INNER)


def test_quality_keeps_columns_with_its_own_names(spark, odd):
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")

    def run(docs):
        scored = materialise(quality.features(docs), "features")
        return quality.judge(scored.withColumn("kept", F.lit("old")), quality.learn(scored, labels, "lang", 0.05, 0.05), "lang").collect()

    rows, plain = run(named(odd)), run(odd)
    assert kept_as_given(rows)
    digest = lambda r: (str(r["doc_id"]), r["n_words"], r["badness"], r["kept"])
    assert sorted(map(digest, rows)) == sorted(map(digest, plain))


def test_language_model_keeps_columns_with_its_own_names(odd):
    model, words = lm_score.train(named(odd), updates=1)
    rows, plain = lm_score.score(named(odd), model, words).collect(), lm_score.score(odd, model, words).collect()
    assert kept_as_given(rows)
    digest = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["score"], 9))
    assert sorted(map(digest, rows)) == sorted(map(digest, plain))


def test_toxicity_keeps_columns_with_its_own_names(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(8)], "doc_id long, toxic int, _key string")
    model = toxicity.fit(named(odd), labels, sample=6)
    rows = toxicity.score(named(odd), model, 0.3).collect()
    assert kept_as_given(rows) and len(rows) == odd.count()
