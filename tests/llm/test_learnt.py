"""Language-model scores, toxicity and near duplicates against brute force and on held-out rows."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import low, words
from pyspark.sql import functions as F

from colloquy.llm import lm_score, near_dedup, toxicity
from colloquy.llm.components import components


# --- language model ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, odd):
    """Two kinds of texts, each with words and endings of its own, and the odd ones."""
    rng = random.Random(2)
    kinds = [[f"{a}{b}ing" for a in "bcdfg" for b in "aeiou"], [f"{a}{b}tz" for a in "klmnp" for b in "aeiou"]]
    rows = [(1000 + i, " ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randint(1, 60))), "en", "s", None, 0.1, "x", 1) for i in range(400)]
    return odd.unionByName(spark.createDataFrame(rows, odd.schema)).cache()


@pytest.fixture(scope="module")
def scored(corpus):
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    model, vocabulary = lm_score.train(corpus.where(~held), updates=6)
    return model, lm_score.score(corpus.withColumn("held", held), model, vocabulary).collect()


def test_base_scores_are_the_counts(corpus, scored):
    counts, n = collections.Counter(), 0
    for r in corpus.collect():
        if r["doc_id"] is None or r["doc_id"] % 5 != 1:
            counts.update([*words(low(r["text"])), "\n"])
    n, z = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    expected = []
    for r in corpus.collect():
        tokens = [*words(low(r["text"])), "\n"]
        base = sum(math.log10(counts.get(t, 0) + 0.5) - z for t in tokens)
        expected.append((str(r["doc_id"]), len(tokens), sum(t in counts for t in tokens), n, round(base, 5)))
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in scored[1]]
    assert sorted(got) == sorted(expected)


def test_model_is_a_distribution_and_beats_the_base_on_held_out_texts(scored):
    model, rows = scored
    contexts = np.arange(0, lm_score.CONTEXTS**2, 97)
    assert np.allclose(np.exp(lm_score.log_probabilities(model.weights, contexts)).sum(1), 1)
    # Words of a class and its one unknown event add up to one.
    inside = (model.totals + 0.5 * model.kinds + 0.5) / (model.totals + 0.5 * (model.kinds + 1))
    assert np.allclose(inside, 1)
    held = [r for r in rows if r["held"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 50
    assert all(r["score"] <= 0 and r["_rest"] in (1, 7, None) for r in rows)


def test_head_words_that_find_no_place_are_joined(corpus, scored, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 3)
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    model, vocabulary = lm_score.train(corpus.where(~held), updates=0)
    few = lm_score.score(corpus, model, vocabulary).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5))
    assert sorted(map(key, few)) == sorted(map(key, scored[1]))


def test_no_training_text_and_no_text(corpus, none):
    model, vocabulary = lm_score.train(none, updates=1)
    rows = lm_score.score(corpus, model, vocabulary).collect()
    assert len(rows) == corpus.count() and all(r["n_known"] == 0 and abs(r["base_score"]) < 1e-6 and r["score"] <= 0 for r in rows)
    assert lm_score.score(none, model, vocabulary).count() == 0


# --- toxicity ---------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_automaton_finds_what_plain_distances_find():
    terms = [("idiot", False), ("scum", False), ("lowei", True), ("stupid", False), ("stup", True)]
    lexicon, rng = toxicity.Lexicon(terms), random.Random(1)

    def plain(word):
        best = -1
        for term, stem in terms:
            near = min(distance(word[:i], term) for i in range(len(word) + 1)) if stem else distance(word, term)
            if near == 0:
                return 0
            best = 1 if near == 1 and len(term) >= toxicity.FUZZY else best
        return best

    for _ in range(6000):
        word = list(rng.choice(["idiot", "scum", "lowei", "stupid", "loweixy", "abc", "stu"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice("idotscumlewpx")])
        word = "".join(word)
        assert not word or lexicon.errors(word) == plain(word), word


@pytest.fixture(scope="module")
def talked(spark, odd):
    rng = random.Random(4)
    calm, bad = [f"calm{i}word" for i in range(60)], ["bastardo", "fiendish", "rottenface"]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(calm) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            for _ in range(3):
                word = rng.choice(bad)
                text.insert(rng.randint(0, len(text)), word if rng.random() < 0.8 else word[:2] + "x" + word[3:])
        rows.append((2000 + i, " ".join(text), "en", "s", None, 0.1, "x", 1))
        labels.append((2000 + i, int(i % 6 == 0)))
    docs = odd.unionByName(spark.createDataFrame(rows, odd.schema)).cache()
    labels += [(None, 1), (3, None), (2001, 0), (9_999_999, 1), (7, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), {2000 + i: int(i % 6 == 0) for i in range(600)}


def test_held_out_documents_are_told_apart(talked, none):
    docs, labels, truth = talked
    model = toxicity.fit(docs, labels, learn_from=F.col("doc_id") % 4 != 2)
    rows = toxicity.score(docs, model, 0.3).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["_rest"] in (1, 7, None) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in truth and r["doc_id"] % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and sum(b for a, b in held if a) >= 0.95 * sum(a for a, _ in held)
    empty = {r["score"] for r in rows if not words(r["text"])}
    assert len(empty) == 1 and empty.pop() < 0.3
    assert toxicity.score(none, model, 0.3).count() == 0


def test_rows_that_share_a_passage_all_count(spark):
    """A long common header, in which most of the least shingle hashes lie, makes no copies; copies leave the smallest doc_id."""
    header = " ".join(f"head{i}" for i in range(300))
    rows = [(100 + i, f"{header} " + " ".join(f"own{i}x{j}" for j in range(60)), 1) for i in range(40)]
    rows += [(500 - i, "the same few words in every one of these rows", 1) for i in range(20)]
    rows += [(900, "the same few words in every one of these rows", 0)]
    held = toxicity._counted_once(spark.createDataFrame(rows, "doc_id long, text string, _toxic int").repartition(5)).collect()
    assert sorted(r["doc_id"] for r in held) == [*range(100, 140), 481, 900]


def test_no_term_beyond_chance_is_cut():
    """More terms than 5,000, the longest of them with the most documents."""
    counts = [(f"term{i}", False, 40, 0) for i in range(10_000, 16_000)] + [("much_longer_term_than_these", False, 400, 0)]
    chosen = toxicity.choose(counts, {40: 6000, 400: 1}, 500, 5000)
    assert sorted(chosen) == sorted((term, stem) for term, stem, _, _ in counts)


def test_without_labels_every_text_gets_one_score(talked, none):
    docs, labels, _ = talked
    for d, given in ((docs, labels.limit(0)), (docs, labels.where("toxic = 0")), (none, labels)):
        model = toxicity.fit(d, given)
        assert len({r["score"] for r in toxicity.score(docs, model, 0.3).collect()}) == 1


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon([("fiendish", False)])
    _, found = toxicity.hits('she said "you fiendish man" and left, fiendish weather', lexicon)
    assert [(e, quoted) for e, quoted, _ in found] == [(0, True), (0, False)] and "said" in found[0][2]


# --- near duplicates --------------------------------------------------------------------


def plain_components(rows, percent):
    sets = []
    for _, text in rows:
        w = words(low(text))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(d), len(s), str(d if not s else least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("block,percent", [(1024, 85), (16, 85), (16, 80)])
def test_components_are_exact(spark, odd, monkeypatch, block, percent):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    passage = [f"shared{i}" for i in range(40)]
    for group in range(4):
        base = [f"g{group}w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 60, 150]))]
        for c in range(60):  # copies that differ from the base, and from each other, by a few words
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = f"new{rng.randint(0, 10**6)}"
            rows.append((5000 + 97 * (group * 60 + c) % 4001, " ".join(text)))
    rows += [(9500 + i, " ".join(passage + [f"own{i}x{k}" for k in range(rng.choice([5, 10, 60]))])) for i in range(60)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):  # each is near the next, the ends are far apart
        chain = chain[3:] + [f"d{i}{k}" for k in range(3)]
        rows.append((9900 - i, " ".join(chain)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(table, percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components(rows, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert near_dedup.near_duplicates(table.limit(0), percent).count() == 0


def test_union_sketches_are_complete():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        a, b = (np.unique(rng.choice(pool, rng.integers(5, 250))) for _ in range(2))
        both, union = np.intersect1d(a, b), np.union1d(a, b)
        k = 64
        exact = np.isin(union[:k], both).sum()
        expected = exact >= 30 if len(union) > k else len(both) * k >= 30 * len(union)
        if len(union) > k or (len(a) <= k and len(b) <= k):
            assert near_dedup._passes(a[:k], b[:k], k, 30) == expected


def test_components_of_links(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_does_not_depend_on_order():
    values = np.array([3, 1, 2], np.uint64)
    assert near_dedup._digest(values) == near_dedup._digest(values[::-1]) != near_dedup._digest(values[:2])
    assert pa.types.is_list(near_dedup._lists([values, values[:0]]).type)


def test_blocks_of_a_hot_list_are_spread(spark):
    still = spark.range(3000).select(F.greatest(F.least("id", F.lit(7)), F.lit(7)).alias("v"), F.col("id").alias("cid"), F.lit(100).cast("long").alias("n"), F.col("id").alias("comp"))
    lists = F.array(F.lit(7).cast("long"))
    spread = near_dedup._spread(still, still.select("cid", lists.alias("sketch")), still.select("cid", lists.alias("listed")))
    plan = spread.groupBy("v", "i", "j").applyInArrow(near_dedup._members(64, 35, 85), "v long")._jdf.queryExecution().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any(re.search(r"hashpartitioning\(v#\w+, i#\w+, j#\w+", line) for line in exchanges), exchanges
    assert spread.groupBy("v", "i", "j").count().count() == 6  # three blocks, paired


def test_long_unlinked_texts_of_one_list(spark, monkeypatch):
    """Fifty texts of 20,000 words that share a passage in pairs of three quarters, and two that are linked."""
    monkeypatch.setattr(near_dedup, "SHINGLES", 100_000)
    rng = random.Random(5)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(15_000)]
    texts = [" ".join(shared + [f"o{i}x{rng.randrange(10**6)}" for _ in range(5_000)]) for i in range(49)]
    texts.append(texts[7] + " one more end")
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 7 if i == 49 else i for i in range(50)}
    assert min(r["n_shingles"] for r in got) > 19_000
