"""Encoders and searches: exactness, conditions, ties, and the paths for large requests."""

import hashlib
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.operators import dense, encode, inside, joins, meaning, prepare, ranking, sparse
from colloquy.plans import queries
from colloquy.session import Size
from colloquy.sources.vector_store import read_vectors, store_vectors

VECTORS = "conv_id long, turn long, chunk int, role string, vec array<float>"
UNITS = "conv_id long, turn long, chunk int, role string, text string"
TINY = Size(rows=0, bytes=0)


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(7)
    rows = [(i % 13, i // 13, 0, ["user", "assistant", None][i % 3], [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(400)]
    rows += [(100, i, 0, "user", rows[0][4]) for i in range(200)]  # copies: their scores tie
    rows += [(200, 0, 0, "user", [0.0] * 8)]
    return spark.createDataFrame(rows, VECTORS).repartition(7).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(20)] + [(99, [0.0] * 8)]
    return spark.createDataFrame(rows, "req_id long, vec array<float>")


def brute(asked_rows, store_rows, k, allowed=lambda q, u: True):
    out = {}
    for q in asked_rows:
        a = np.array(q["vec"], dtype=float)
        found = []
        for u in store_rows:
            b = np.array(u["vec"], dtype=float)
            if a.any() and b.any() and allowed(q, u):
                found.append((-round(float(a @ b / math.sqrt((a @ a)) / math.sqrt(b @ b)), 9), u["conv_id"], u["turn"], u["chunk"]))
        for rank, hit in enumerate(sorted(found)[: (q["k"] if "k" in q else k)], 1):
            out[q["req_id"], rank] = (hit[1], hit[2], hit[3], round(-hit[0], 6))
    return out


def agree(got, expected):
    """The same hits at the same ranks; scores may differ in the last digit, by the way halves are rounded."""
    assert {q: hit[:3] for q, hit in got.items()} == {q: hit[:3] for q, hit in expected.items()}
    assert all(abs(hit[3] - expected[q][3]) < 2e-6 for q, hit in got.items())


def found(hits):
    return {(r["req_id"], r["rank"]): (r["conv_id"], r["turn"], r["chunk"], r["score"]) for r in hits.collect()}


BLOCKS = {"matrix": Size(rows=12, bytes=10**6)}


@pytest.mark.parametrize("how", [{}, BLOCKS], ids=["matrix", "blocks"])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_semantic_search_equals_brute_force(asked, store, how, k):
    hits = found(dense.semantic_search(asked, store, k, **how))
    agree(hits, brute([r.asDict() for r in asked.collect()], store.collect(), k))


@pytest.mark.parametrize("how", [{}, BLOCKS], ids=["matrix", "blocks"])
def test_conditions_apply_before_ranking(spark, asked, store, how):
    odd = F.col("req_id") % 2 == 1
    conditions = {
        "conv_ids": F.when(odd, F.array(F.lit(3).cast("long"), F.lit(5).cast("long"), F.lit(100).cast("long"))),
        "roles": F.when(F.col("req_id") > 3, F.array(F.lit("user"))),
        "exclude_conv": F.when(F.col("req_id") > 6, F.lit(100).cast("long")),
        "k": (F.col("req_id") % 4 + 1).cast("int"),
    }
    limited = asked.withColumns(conditions)

    def allowed(q, u):
        return (
            (q["conv_ids"] is None or u["conv_id"] in q["conv_ids"])
            and (q["roles"] is None or u["role"] in q["roles"])
            and (q["exclude_conv"] is None or u["conv_id"] != q["exclude_conv"])
        )

    expected = brute([r.asDict() for r in limited.collect()], store.collect(), 2, allowed)
    agree(found(dense.semantic_search(limited, store, 2, **how)), expected)


def test_small_tiles_change_nothing(asked, store, monkeypatch):
    whole = found(dense.semantic_search(asked, store, 5))
    monkeypatch.setattr(inside, "TILE", 300)
    agree(found(dense.semantic_search(asked, store, 5)), whole)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_result_does_not_depend_on_partitions(asked, store, parts):
    agree(found(dense.semantic_search(asked, store.repartition(parts), 5)), found(dense.semantic_search(asked, store, 5)))


def test_vector_of_another_length_fails(spark, asked):
    bad = spark.createDataFrame([(1, 0, 0, "user", [1.0, 2.0])], VECTORS)
    with pytest.raises(PySparkException, match="8 values"):
        dense.semantic_search(asked, bad, 1).collect()


def test_no_requests_give_no_hits(spark, asked, store):
    assert dense.semantic_search(asked.filter("req_id < 0"), store, 3).count() == 0


def test_unit_is_its_own_nearest_neighbour(store):
    own = store.filter("conv_id < 13").select((F.col("conv_id") * 1000 + F.col("turn")).alias("req_id"), "vec")
    top = dense.semantic_search(own, store, 1).collect()
    assert all(r["score"] == 1.0 for r in top)


# --- text -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(3)
    word = lambda: "the" if rng.random() < 0.4 else f"w{int(rng.zipf(1.6)) % 60}"
    rows = [(i % 9, i // 9, 0, ["user", "assistant"][i % 2], " ".join(word() for _ in range(12))) for i in range(120)]
    return spark.createDataFrame([*rows, (50, 0, 0, "user", "...")], UNITS)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "the w1 w2 w2"), (2, "w3 the unknownword"), (3, "nothing known"), (4, "?!")], "req_id long, text string")


def plain_bags(rows):
    out = {}
    for r in rows:
        bag = {}
        for w in r["text"].lower().replace(".", " ").replace("?", " ").replace("!", " ").split():
            bag[w] = bag.get(w, 0) + 1
        if bag:
            out[r["conv_id"], r["turn"], r["chunk"], r["role"]] = bag
    return out


def plain_rank(scores, k):
    order = sorted((-round(s, 9), *key) for key, s in scores.items())[:k]
    return [(*hit[1:], round(-hit[0], 6)) for hit in order]


def plain_tfidf(bag, df, n):
    w = {t: (1 + math.log(c)) * (math.log((n + 1) / (df.get(t, 0) + 1)) + 1) for t, c in bag.items()}
    length = math.sqrt(sum(x * x for x in w.values()))
    return {t: x / length for t, x in w.items()}


def by_request(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["req_id"], []).append((r["conv_id"], r["turn"], r["chunk"], r["score"]))
    return out


@pytest.fixture(params=["matrix", "blocks", "salted"])
def words_path(request, monkeypatch):
    if request.param == "salted":
        original = joins.join_small
        for module in (encode, sparse):
            monkeypatch.setattr(module, "join_small", lambda *a, **kw: original(*a, **{**kw, "max_rows": 0}))
    return {} if request.param == "matrix" else {"words": Size(rows=20, bytes=10**6)}


def test_term_search_equals_plain_python(spark, units, questions, words_path):
    store_bags = plain_bags(units.collect())
    df = {}
    for bag in store_bags.values():
        for t in bag:
            df[t] = df.get(t, 0) + 1
    n = len(store_bags)
    weighted = {key[:3]: plain_tfidf(bag, df, n) for key, bag in store_bags.items()}
    stats = encode.corpus_stats(units)
    assert (stats.n_units, stats.n_words) == (120, 120 * 12)
    hits = by_request(sparse.term_search(encode.tfidf_requests(questions, stats), encode.tfidf_rows(units, stats), 5, **words_path))
    for q, text in [(1, "the w1 w2 w2"), (2, "w3 the unknownword")]:
        asked = plain_tfidf({w: text.split().count(w) for w in text.split()}, df, n)
        scores = {key: sum(asked[t] * w[t] for t in asked if t in w) for key, w in weighted.items() if set(asked) & set(w)}
        assert hits[q] == plain_rank(scores, 5)
    assert set(hits) == {1, 2}


def test_bm25_equals_plain_python(spark, units, questions, words_path):
    store_bags = plain_bags(units.collect())
    stats = encode.corpus_stats(units)
    hits = by_request(sparse.bm25_search(questions, units, 5, stats, **words_path))
    mean = sum(sum(b.values()) for b in store_bags.values()) / len(store_bags)
    for q, text in [(1, "the w1 w2 w2"), (2, "w3 the unknownword")]:
        scores = {}
        for key, bag in store_bags.items():
            for t in text.split():
                if t in bag:
                    df = sum(t in b for b in store_bags.values())
                    idf = math.log(1 + (len(store_bags) - df + 0.5) / (df + 0.5))
                    part = idf * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
                    scores[key[:3]] = scores.get(key[:3], 0) + part
        assert hits[q] == plain_rank(scores, 5)


def frequent_words(n_units=4_000, n_asked=100):
    """Requests that share all of their words with each other and with all units, as what tasks get."""
    names = [f"w{i}" for i in range(40)]
    asked = pa.table({"req_id": np.repeat(np.arange(n_asked), 40), "term": names * n_asked, "weight": np.linspace(1, 2, 40 * n_asked)})
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n_units + 1, dtype=np.int32) * 40), pa.array(names * n_units))
    keys = [pa.array(np.arange(n_units)), pa.array(np.zeros(n_units, np.int64)), pa.array(np.zeros(n_units, np.int32))]
    return asked, pa.RecordBatch.from_arrays([*keys, lists], names=["conv_id", "turn", "chunk", "words"])


def test_frequent_words_take_no_more_memory(monkeypatch):
    asked, batch = frequent_words()  # 16 M pairs of words: 128 MB as one array of numbers
    read, search = sparse._searcher(["conv_id", "turn", "chunk"], [], 5, (1.2, 0.75, 40.0))
    tracemalloc.start()
    hits = search(read(asked), iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    for pairs in (1, 10**9):
        monkeypatch.setattr(inside, "PAIRS", pairs)
        read, search = sparse._searcher(["conv_id", "turn", "chunk"], [], 5, (1.2, 0.75, 40.0))
        assert search(read(asked), iter([batch])).equals(hits)


def test_a_large_vocabulary_is_looked_up_in_arrow():
    places, known = inside.make_places(), pa.array([f"word{i}" for i in range(300_000)])
    tracemalloc.start()
    at = places(pa.array(["word7", "none", "word299999", ""]), known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at.tolist() == [7, -1, 299_999, -1] and peak < 2 << 20
    assert places(pa.array([], pa.string()), known).tolist() == [] and places(pa.array(["a"]), pa.array([], pa.string())).tolist() == [-1]


def test_conditions_of_term_search(spark, units, questions, words_path):
    stats = encode.corpus_stats(units)
    limited = questions.withColumns({"roles": F.array(F.lit("user")), "exclude_conv": F.lit(0).cast("long"), "k": F.lit(2)})
    hits = sparse.term_search(encode.tfidf_requests(limited, stats), encode.tfidf_rows(units, stats), 5, **words_path)
    said = hits.join(units, ["conv_id", "turn", "chunk"]).collect()
    assert {r["role"] for r in said} == {"user"} and 0 not in {r["conv_id"] for r in said}
    assert sorted(r["rank"] for r in said if r["req_id"] == 1) == [1, 2]


def test_large_vocabularies_are_split_by_frequency(spark, units, monkeypatch):
    stats = encode.corpus_stats(units)
    monkeypatch.setattr(encode, "HOT_WORDS", 5)
    flat = lambda rows: rows.select("conv_id", "turn", "chunk", F.inline("terms")).orderBy("conv_id", "turn", "chunk", "term").collect()
    joined = encode.tfidf_rows(units, stats, small=TINY)
    here, there = flat(encode.tfidf_rows(units, stats)), flat(joined)
    assert [r[:5] for r in here] == [r[:5] for r in there] and np.allclose([r["weight"] for r in here], [r["weight"] for r in there])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan and "SortMergeJoin" in plan


def test_blocks_of_requests_leave_the_store_where_it_is(spark, asked, store):
    hits = dense.semantic_search(asked, store, 5, **BLOCKS)
    scanned = hits._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in scanned and "Exchange hashpartitioning(req_id" in scanned


def test_tfidf_has_unit_length_and_moves_no_text(spark, units):
    stats = encode.corpus_stats(units)
    weighted = encode.tfidf(units, stats)
    lengths = weighted.groupBy("conv_id", "turn", "chunk").agg(F.sum(F.col("weight") ** 2).alias("l")).collect()
    assert len(lengths) == 120 and all(abs(r["l"] - 1) < 1e-9 for r in lengths)
    plan = weighted._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange" not in plan


def test_restrict_with_lists_and_tables(spark, units):
    wanted = spark.createDataFrame([(3,), (4,), (3,)], "c long")
    rows = ranking.restrict(units, conv_ids=wanted, roles=["user"]).collect()
    expected = [r for r in units.collect() if r["conv_id"] in (3, 4) and r["role"] == "user"]
    key = lambda r: (r["conv_id"], r["turn"], r["chunk"], r["role"], r["text"])
    assert sorted(map(key, rows)) == sorted(map(key, expected))


def test_hash_vectors_equal_plain_python(spark, units):
    import hashlib

    rows = encode.hash_vectors(units, 32).collect()
    assert len(rows) == 120
    store_bags = plain_bags(units.collect())
    for r in rows:
        expected = np.zeros(32)
        for t, n in store_bags[r["conv_id"], r["turn"], r["chunk"], r["role"]].items():
            h = hashlib.md5(t.encode()).hexdigest()
            expected[int(h[:8], 16) % 32] += n if int(h[8:12], 16) % 2 == 0 else -n
        assert r["vec"] == expected.tolist()
        assert r["norm"] == pytest.approx(math.sqrt((expected**2).sum()))
        assert (r["dim"], r["encoder"]) == (32, "hash-md5-32")


# --- models ---------------------------------------------------------------------------


def test_context_vectors_are_the_sums_of_the_index_vectors_beside(spark):
    said = spark.createDataFrame([("a b c d",), ("a b",), (None,), ("",), ("x",)], "text string")
    got = {(r["term"], r["bucket"]): r["value"] for r in meaning.context_counts(said, 8, 2).collect()}
    expected = {}
    for words in (["a", "b", "c", "d"], ["a", "b"]):
        for i, w in enumerate(words):
            for j, c in enumerate(words):
                if 1 <= abs(i - j) <= 2:
                    h = hashlib.md5(c.encode()).hexdigest()
                    at = (w, int(h[:8], 16) % 8)
                    expected[at] = expected.get(at, 0) + (1 if int(h[8:12], 16) % 2 == 0 else -1)
    assert got == {k: v for k, v in expected.items() if v}


def test_meaning_does_not_depend_on_partitions_or_on_the_path(spark, units):
    said = units.select("text")
    counts = [sorted(map(tuple, meaning.context_counts(said.repartition(n)).collect())) for n in (1, 13)]
    assert counts[0] == counts[1] and counts[0]
    stats, vectors = encode.corpus_stats(units), meaning.word_vectors(meaning.context_counts(said))
    for made in (
        lambda small: meaning.meaning_vectors(units, stats, vectors, small=small).orderBy("conv_id", "turn", "chunk"),
        lambda small: meaning.meaning_requests(
            units.select(F.col("conv_id").alias("req_id"), "text").dropDuplicates(["req_id"]), stats, vectors, small=small
        ).orderBy("req_id"),
    ):
        here, joined = (np.array([r["vec"] for r in made(small).collect()]) for small in (meaning.SMALL, TINY))
        assert here.shape == joined.shape and np.allclose(here, joined) and np.abs(here).sum() > 0


def test_encode_applies_the_users_model(spark, units):
    def load():
        return lambda texts: np.array([[len(t), t.count("w"), 1.0] for t in texts])

    for r in encode.encode(units, load, 3, "toy").join(units, ["conv_id", "turn", "chunk"]).collect():
        assert r["vec"] == [len(r["text"]), r["text"].count("w"), 1.0]


@pytest.mark.parametrize("model", [lambda texts: np.ones((len(texts), 2)), lambda texts: np.full((len(texts), 3), np.nan)])
def test_encode_refuses_unsound_vectors(spark, units, model):
    with pytest.raises(PySparkException, match="finite vectors of length 3"):
        encode.encode(units, lambda: model, 3, "toy").collect()


# --- approximate ----------------------------------------------------------------------


def test_lsh_scores_are_exact_and_near_copies_are_found(spark, asked, store):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 16))
    rows = [(i, 0, 0, "user", [float(x) for x in v]) for i, v in enumerate(base)]
    near = [(i, [float(x) for x in base[i] + 0.05 * rng.normal(size=16)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, VECTORS)
    requests = spark.createDataFrame(near, "req_id long, vec array<float>")
    exact = found(dense.semantic_search(requests, vectors, 1))
    approx = found(dense.lsh_search(requests, vectors, 1, 16, tables=8, bits=6))
    same = sum(exact[q] == approx.get(q) for q in exact)
    assert same / len(exact) >= 0.95


@pytest.fixture(params=["matrix", "broadcast", "salted"])
def lsh_path(request, monkeypatch):
    if request.param == "salted":
        original = joins.join_small
        monkeypatch.setattr(dense, "join_small", lambda *a, **kw: original(*a, **{**kw, "max_rows": 0}))
    return {} if request.param == "matrix" else {"matrix": TINY}


def test_lsh_with_no_bits_is_exact(asked, store, lsh_path):
    agree(found(dense.lsh_search(asked, store, 5, 8, tables=2, bits=0, **lsh_path)), found(dense.semantic_search(asked, store, 5)))


def test_lsh_paths_agree(asked, store, lsh_path):
    limited = asked.withColumns({"roles": F.array(F.lit("user")), "exclude_conv": F.lit(3).cast("long"), "k": F.lit(4)})
    paths = [found(dense.lsh_search(limited, store, 9, 8, tables=3, bits=2, **how)) for how in ({}, lsh_path)]
    agree(*paths)
    assert len(paths[0]) == 4 * 20


def test_lsh_paths_agree_on_near_codes(asked, store, lsh_path):
    paths = [found(dense.lsh_search(asked, store, 5, 8, tables=2, bits=5, flips=2, **how)) for how in ({}, lsh_path)]
    agree(*paths)
    assert paths[0]


def test_lsh_finds_most_of_the_true_hits(spark):
    """recall@5 on the registered queries' own data, against exact search."""
    sf_dir, key = "/root/testdata/sf0.1", ["req_id", "conv_id", "turn", "chunk"]
    exact = {tuple(r) for r in queries.hash_search(spark, sf_dir).select(key).collect()}
    assert len(exact) == 1000
    for search in (queries.lsh_search, queries.lsh_near_search, queries.probed_search):
        near = {tuple(r) for r in search(spark, sf_dir).select(key).collect()}
        assert len(exact & near) / len(exact) >= 0.9


def test_conditions_of_all_requests_reach_the_scan(spark, tmp_path):
    rows = [(c, 0, 0, "user" if c % 2 else "assistant", [1.0, float(c)], "toy", 2, 1.0) for c in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, chunk int, role string, vec array<float>, encoder string, dim int, norm double")
    store_vectors(table, str(tmp_path / "s"), 2, buckets=8)
    asked = spark.createDataFrame([(1, [1.0, 0.0], [3, 4]), (2, [0.0, 1.0], [4])], "req_id long, vec array<float>, conv_ids array<long>")
    kept = ranking.restrict_to(asked, read_vectors(spark, str(tmp_path / "s"), "toy"), buckets=8)
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET)", text)
    assert sorted(r["conv_id"] for r in kept.collect()) == [3, 4]
    roles = asked.select("req_id", "vec", F.array(F.lit("user")).alias("roles"))
    text = ranking.restrict_to(roles, table.drop("vec").select("role", "conv_id"))._jdf.queryExecution().executedPlan().toString()
    assert "user" in text
    free = spark.createDataFrame([(1, [1.0], None), (2, [1.0], [4])], "req_id long, vec array<float>, conv_ids array<long>")
    assert ranking.restrict_to(free, table) is table


def test_chunks_feed_the_encoders(spark):
    said = spark.createDataFrame([(1, 0, "user", "a b c d e"), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert encode.hash_vectors(prepare.chunk(said, 3, 1), 8).count() == 2
