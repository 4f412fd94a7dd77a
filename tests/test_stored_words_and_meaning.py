"""Stored words and stored meaning: equal to the searches that read all text, before and after what is stored changes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.operators import encode, indexed, meaning, sparse
from colloquy.operators.prepare import chunk
from colloquy.plans import answer, meaning_store
from colloquy.plans.queries import export_json
from colloquy.session import Size
from colloquy.sources import term_index
from colloquy.sources.transcripts import read_log
from colloquy.streaming.ingest import ingest_stream

UTTERANCE = "conv_id long, turn long, role string, text string"


def said(n, seed=1, turns=6):
    """Utterances over a few very frequent words and many rare ones; some are equal, some have no words or no text."""
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(["the", "of", "and", rng.choice(rare), rng.choice(rare)]) for _ in range(rng.randint(1, 70)))
        rows.append((i // turns, i % turns, rng.choice(["user", "assistant"]), {7: None, 11: "...", 13: rows[2][3] if i > 2 else text}.get(i % 29, text)))
    return rows


@pytest.fixture(scope="module")
def utterances(spark):
    return spark.createDataFrame(said(400), UTTERANCE).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(3)
    texts = [" ".join(["the", "of", *[f"w{rng.randrange(320)}" for _ in range(n)]]) for n in (1, 3, 8, 20)]
    texts += ["the the of", "w5", "unheard words only", "", None, "w1 w1 w1 w2", said(3)[2][3]]
    return spark.createDataFrame(list(enumerate(texts)), "req_id long, text string").cache()


def rows(hits):
    return sorted(tuple(r) for r in hits.collect())


# --- words --------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "seeds", "k"), [(512, 4096, 5), (4, 30, 5), (4, 0, 3), (16, 200, 40)])
def test_stored_bm25_equals_bm25(spark, utterances, asked, tmp_path, monkeypatch, block, seeds, k):
    monkeypatch.setattr(indexed, "SEEDS", seeds)
    units = chunk(utterances)
    term_index.store_terms(units, str(tmp_path), buckets=8, block=block)
    got = indexed.stored_bm25_search(spark, asked, str(tmp_path), k)
    assert rows(got) == rows(sparse.bm25_search(asked, units, k, encode.corpus_stats(units)))


def test_sums_over_strong_words_leave_out_candidates(spark, tmp_path, monkeypatch):
    """Units with one of four strong words each are candidates by the bound of the rarest, not by that of units with all."""
    said = lambda i: " ".join(["the", f"other{i}", *[f"s{j}" for j in range(4) if i < 10 or i % 4 == j]])
    rows = [(i, 0, 0, "user", said(i)) for i in range(400)]
    units = spark.createDataFrame(rows, "conv_id long, turn long, chunk int, role string, text string")
    asked = spark.createDataFrame([(1, "the s0 s1 s2 s3")], "req_id long, text string")
    term_index.store_terms(units, str(tmp_path), buckets=4, block=16)
    monkeypatch.setattr(indexed, "SEEDS", 1)
    written = {}

    def noted(df, name, make=indexed.materialise):
        written[name] = make(df, name)
        return written[name]

    monkeypatch.setattr(indexed, "materialise", noted)
    got = indexed.stored_bm25_search(spark, asked, str(tmp_path), 5).orderBy("rank").collect()
    assert got == sparse.bm25_search(asked, units, 5, encode.corpus_stats(units)).orderBy("rank").collect()
    assert written["candidates"].count() > 100 and written["better-candidates"].count() == 10


def test_stored_bm25_with_conditions(spark, utterances, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(indexed, "SEEDS", 40)
    units = chunk(utterances)
    term_index.store_terms(units, str(tmp_path), buckets=8, block=8)
    some = asked.withColumns({
        "roles": F.when(F.col("req_id") % 2 == 0, F.array(F.lit("user"))),
        "exclude_conv": F.when(F.col("req_id") % 3 == 0, F.lit(4).cast("long")),
        "conv_ids": F.when(F.col("req_id") == 3, F.array(*[F.lit(i).cast("long") for i in range(20)])),
        "k": F.when(F.col("req_id") == 2, F.lit(9)),
    })
    got = indexed.stored_bm25_search(spark, some, str(tmp_path), 4)
    assert rows(got) == rows(sparse.bm25_search(some, units, 4, encode.corpus_stats(units)))


def test_words_of_a_large_vocabulary_are_indexed_alike(spark, utterances, tmp_path, monkeypatch):
    units = chunk(utterances)
    term_index.store_terms(units, f"{tmp_path}/a", buckets=4, block=8)
    monkeypatch.setattr(term_index, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(encode, "HOT_WORDS", 40)
    term_index.store_terms(units, f"{tmp_path}/b", buckets=4, block=8)
    read = lambda name: sorted(map(str, term_index.units_of(spark.read.parquet(f"{tmp_path}/{name}/postings")).collect()))
    assert read("a") == read("b")
    assert encode.corpus_stats(units).hot().count() <= 40


def test_index_reads_the_buckets_of_its_words_and_leaves_blocks_out(spark, utterances, tmp_path):
    corpus = term_index.store_terms(chunk(utterances), str(tmp_path), buckets=16, block=8)
    one = spark.createDataFrame([("w5",)], "term string")
    stored = term_index.read_terms(spark, str(tmp_path), "postings", one, 16)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", stored._jdf.queryExecution().executedPlan().toString())
    assert stored.select("bucket").distinct().count() == 1
    hot = spark.read.parquet(f"{tmp_path}/postings").filter("term = 'the'")
    assert hot.count() > 20 and hot.agg(F.max(F.size("tf_list"))).first()[0] < 40  # no list is held together
    asked = indexed.request_bounds(spark, spark.createDataFrame([(1, "the of w5 w6")], "req_id long, text string"), str(tmp_path), corpus)
    assert {r["term"] for r in asked.orderBy("most").limit(2).collect()} == {"the", "of"}


def test_index_of_nothing(spark, utterances, asked, tmp_path):
    term_index.store_terms(chunk(utterances).limit(0), str(tmp_path), buckets=4)
    assert indexed.stored_bm25_search(spark, asked, str(tmp_path), 5).count() == 0


# --- meaning ------------------------------------------------------------------------------


class Log:
    def __init__(self, spark, path):
        self.spark, self.landed, self.log, self.offsets = spark, f"{path}/landed", f"{path}/log", f"{path}/offsets"
        self.store = f"{path}/store"

    def land(self, rows):
        export_json(self.spark.createDataFrame(rows, UTTERANCE), self.landed)
        ingest_stream(self.spark, self.landed, self.log, self.offsets, buckets=4)


@pytest.fixture()
def log(spark, tmp_path):
    made = Log(spark, str(tmp_path))
    made.land(said(120))
    meaning_store.build_meaning_store(spark, made.log, made.store, dim=16, buckets=4)
    return made


def from_nothing(spark, log):
    now = meaning_store._utterances(read_log(spark, log.log))
    return now, chunk(now)


def test_refresh_equals_a_build_from_nothing(spark, log, asked):
    now, units = from_nothing(spark, log)
    assert rows(meaning_store.stored_meaning_hits(spark, asked, log.store, 4)) == rows(answer.meaning_hits(asked, now, units, 4, 16))
    assert meaning_store.refresh_meaning(spark, log.log, log.store) == 1  # nothing has landed
    changed = [(c, t, r, None if c == 3 else "" if c == 4 else f"quite new words {t} the w7") for c, t, r, _ in said(120) if c in (3, 4, 5)]
    log.land(changed + [(1000, t, "user", "another meeting of w9 and w9") for t in range(3)])
    assert meaning_store.refresh_meaning(spark, log.log, log.store) == 2
    now, units = from_nothing(spark, log)
    counts = spark.read.parquet(f"{log.store}/model").select("term", "bucket", "value")
    assert rows(meaning.added(counts).fillna({"term": ""})) == rows(meaning.model_counts(now, units, 16).fillna({"term": ""}))
    delta = spark.read.parquet(f"{log.store}/model/version=2")
    assert delta.filter("value < 0").count() and delta.count() < meaning.model_counts(now, units, 16).count()
    assert rows(meaning_store.stored_meaning_hits(spark, asked, log.store, 4)) == rows(answer.meaning_hits(asked, now, units, 4, 16))
    old = meaning_store.encode_requests(spark, asked, log.store, version=1)
    with pytest.raises(ValueError, match="encoded by context-1"):
        meaning_store.search_meaning(spark, old, log.store, 4)
    assert meaning_store.search_meaning(spark, old, log.store, 4, version=1).count() > 0  # the version before can still be asked
    assert meaning_store.forget(spark, log.store) == [1] and meaning_store.versions(spark, log.store) == [2]
    with pytest.raises(ValueError, match="not published"):
        meaning_store.stored_meaning_hits(spark, asked, log.store, 4, version=1)


def test_a_refresh_that_died_is_run_again(spark, log, asked, monkeypatch):
    log.land([(2, 0, "user", "a correction of w3 w4"), (500, 1, "user", "late words")])

    def dies(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(meaning_store, "_note", dies)
        with pytest.raises(RuntimeError):
            meaning_store.refresh_meaning(spark, log.log, log.store)
    assert meaning_store.versions(spark, log.store) == [1]
    assert meaning_store.refresh_meaning(spark, log.log, log.store) == 2
    now, units = from_nothing(spark, log)
    assert rows(meaning_store.stored_meaning_hits(spark, asked, log.store, 4)) == rows(answer.meaning_hits(asked, now, units, 4, 16))


def test_unpublished_store(spark, asked, tmp_path):
    with pytest.raises(ValueError, match="not published"):
        meaning_store.stored_meaning_hits(spark, asked, f"{tmp_path}/none", 4)
    with pytest.raises(ValueError, match="no published version"):
        meaning_store.refresh_meaning(spark, f"{tmp_path}/log", f"{tmp_path}/none")


def test_vectors_by_any_vocabulary_are_the_same(spark, utterances, monkeypatch):
    units = chunk(utterances)
    stats = encode.corpus_stats(units)
    vectors = meaning.word_vectors(meaning.context_counts(utterances, 16), 16)
    small = meaning.meaning_vectors(units, stats, vectors, 16)
    monkeypatch.setattr(encode, "HOT_WORDS", 30)
    large = meaning.meaning_vectors(units, stats, vectors, 16, small=Size(0, 0))
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "posexplode(vec" not in plan
    near = lambda df: sorted((r["conv_id"], r["turn"], r["chunk"], [round(x, 9) + 0.0 for x in r["vec"]]) for r in df.collect())
    assert near(small) == near(large) and 0 < stats.hot().count() <= 30


def test_rare_words_cost_their_entries_and_meet_rows_alike(spark, utterances, monkeypatch):
    units = chunk(utterances)
    stats = encode.corpus_stats(units)
    vectors = meaning.word_vectors(meaning.context_counts(utterances, 64), 64, stats)
    once = meaning.word_vectors(meaning.context_counts(spark.createDataFrame([("a b c d e f g",)], "text string"), 64), 64)
    assert all(len(r["at"]) == len(r["n"]) <= 4 for r in once.collect())  # two words on either side, and no 64 numbers
    monkeypatch.setattr(encode, "HOT_WORDS", 5)
    exact = lambda small: sorted(tuple(map(str, r)) for r in meaning.meaning_vectors(units, stats, vectors, 64, small=small).collect())
    least = [meaning._least_df(vectors, stats, small)[0] for small in (meaning.SMALL, Size(200, 1 << 30), Size(0, 0))]
    assert least[0] == 0 < least[1] < least[2]
    near = lambda rows: [(r[:4], [round(float(x), 9) + 0.0 for x in r[4][1:-1].split(",")]) for r in rows]
    whole, some, few = (near(exact(small)) for small in (meaning.SMALL, Size(200, 1 << 30), Size(0, 0)))
    assert whole == some == few and whole


def test_lists_of_counts_are_merged_whatever_the_batches(spark):
    """Words go on over batches, some cancel out, one is NULL; sums are by word and place, ascending."""
    counts = [(None if w == 9 else f"w{w:03}", i % 5 - 2, (i % 7) - 3) for i in range(4000) for w in (i % 97, 9, 50)]
    expected = {}
    for term, bucket, value in counts:
        expected[term, bucket] = expected.get((term, bucket), 0) + value
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        lists = meaning._lists(spark.createDataFrame(counts, "term string, bucket int, value long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len({r["term"] for r in lists}) == len(lists) and all(r["at"] == sorted(r["at"]) for r in lists)
    got = {(r["term"], b): v for r in lists for b, v in zip(r["at"], r["n"])}
    assert got == {k: v for k, v in expected.items() if v}
