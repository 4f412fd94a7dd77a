"""Toxicity by a learnt lexicon, misspellings included, and the words around each hit.

Lexicon: words and stems (first letters) that labelled toxic documents have and others
have not, beyond chance. Its terms stand in a trie. A word is looked up by walking the trie
together with the word's Levenshtein automaton (bit-parallel: one row of bits per number of
errors), which finds all terms within one insertion, deletion or substitution; short terms
must match exactly. A hit is looked at in its window: whether quotation marks enclose it, and
which words stand beside it, weighed by what labelled documents have there. A logistic
regression over the hits of a document gives its score.

The lexicon and the regression are fitted on at most `sample` labelled documents, chosen by
the hash of doc_id; every document is scored over its whole text. Of labelled rows of one kind
whose `SKETCH` least shingle hashes are all equal (all hashes, in shorter texts), the smallest
doc_id counts alone; rows that merely share a passage all count.

Results in special cases: a null or empty text has no hits and gets the score of a text
without hits; null doc_ids are scored but never learnt from; a document with several labels
is toxic if one says so; labels that are null are left out. Without labels of both kinds
the score is the smoothed share of toxic labels, for every text. Repeated rows are scored
each. Other columns are kept, but columns named score and predicted are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.cuts import cut
from colloquy.llm.ship import ship
from colloquy.llm.words import Words, by_bytes, shingles
from colloquy.session import materialise

SAMPLE = 20_000  # labelled documents that lexicon and regression are fitted on
SKETCH = 16  # least shingle hashes that near copies have in common
FUZZY = 5  # terms of so many letters or more may have one error
STEMS = (4, 5, 6)
NEAR = 6  # words on each side of a hit
CACHE = 200_000
_TOKEN = re.compile(r"\w(?:[\w*@$!]*\w)?|[\"“”„«»]")
_QUOTES = frozenset("\"“”„«»")
N_FEATURES = 7


class Lexicon:
    """Terms in a trie; `find` intersects it with the automaton of a word."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # 1: a word ends here, 2: a stem, 3: both
        for term, stem in terms:
            at = 0
            for sign in term:
                if sign not in self.nodes[at]:
                    self.nodes[at][sign] = len(self.nodes)
                    self.nodes.append({})
                    self.ends.append(0)
                at = self.nodes[at][sign]
            self.ends[at] |= 2 if stem else 1
        # One error leaves the first two letters as they are, or the three after them.
        self.heads = {t[:2] for t, _ in terms}
        self.later = {t[2:5] for t, _ in terms if len(t) >= FUZZY}
        self.known: dict[str, int] = {}

    def __reduce__(self):
        return (_restored, (self.nodes, self.ends, self.heads, self.later))

    def errors(self, word: str) -> int:
        """0 or 1 errors of the nearest term, or -1 if none is near."""
        found = self.known.get(word)
        if found is None:
            near = word[:2] in self.heads or any(word[k : k + 3] in self.later for k in (1, 2, 3))
            found = self.find(word) if near else -1
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    def find(self, word: str) -> int:
        place: dict[str, int] = {}
        for i, sign in enumerate(word):
            place[sign] = place.get(sign, 0) | 1 << (i + 1)
        last = 1 << len(word)
        best = -1
        todo = [(0, 0, 1, 0b10 | 1)]  # node, depth, bits without errors, bits with at most one
        while todo:
            node, depth, none, one = todo.pop()
            kind = self.ends[node]
            if kind:
                if kind & 1 and none & last or kind & 2 and none:
                    return 0
                if depth >= FUZZY and (kind & 1 and one & last or kind & 2 and one):
                    best = 1
            for sign, child in self.nodes[node].items():
                mask = place.get(sign, 0)
                exact = none << 1 & mask
                near = (one << 1 & mask | none | none << 1 | exact << 1 | exact) & ((last << 1) - 1)
                if near:
                    todo.append((child, depth + 1, exact, near))
        return best


def _restored(nodes, ends, heads, later) -> Lexicon:
    made = Lexicon([])
    made.nodes, made.ends, made.heads, made.later = nodes, ends, heads, later
    return made


def hits(text: str, lexicon: Lexicon):
    """Number of words, and per hit: errors, whether quoted, the words around it."""
    tokens = _TOKEN.findall(text.lower())
    find, known = lexicon.errors, lexicon.known
    found = [(i, e) for i, w in enumerate(tokens) if (e := known[w] if w in known else find(w)) >= 0]
    out = []
    for i, e in found:
        before, after = tokens[max(0, i - NEAR) : i], tokens[i + 1 : i + 1 + NEAR]
        quoted = any(w in _QUOTES for w in before) and any(w in _QUOTES for w in after)
        around = [w for w in before + after if w not in _QUOTES and find(w) < 0]
        out.append((e, quoted, around))
    return len(tokens), out


def measured(text: str, lexicon: Lexicon, context: dict[str, float]) -> list[float]:
    """The features of a text: hits by kind, their rate, and what stands around them."""
    n, found = hits(text, lexicon)
    count = Counter((e, q) for e, q, _ in found)
    words = [w for _, _, around in found for w in around]
    beside = sum(context.get(w, 0.0) for w in words) / max(1, len(words))
    return [
        1.0,
        math.log1p(count[0, False]), math.log1p(count[0, True]), math.log1p(count[1, False]), math.log1p(count[1, True]),
        math.log1p(100 * len(found) / max(1, n)), beside,
    ]


def _log_tail(k: int, n: int, p: float) -> float:
    """An upper bound of ln P(X >= k), X binomial(n, p), for k above the mean: Chernoff's."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def beyond_chance(sizes: dict[int, int], toxic: int, other: int):
    """A test of (t, c), documents with a term: of all terms as frequent, less than one half is expected to look so by accident."""
    share = toxic / (toxic + other)
    as_frequent, total = {}, 0
    for size in sorted(sizes, reverse=True):
        total += sizes[size]
        as_frequent[size] = total

    def passes(t: int, c: int) -> bool:
        pure = t / toxic / (t / toxic + (c + 0.5) / (other + 1))
        return pure >= 0.8 and t >= 4 * c and _log_tail(t, t + c, share) + math.log(as_frequent[t + c]) <= math.log(0.5)

    return passes


def choose(counts: list[tuple[str, bool, int, int]], sizes: dict[int, int], toxic: int, other: int) -> list[tuple[str, bool]]:
    """All terms beyond chance, less those that others cover."""
    passes = beyond_chance(sizes, toxic, other)
    good = {(term, stem): t for term, stem, t, c in counts if passes(t, c)}
    longer: dict[str, int] = {}  # the most that a stem one letter longer says
    for (term, stem), t in good.items():
        if stem:
            longer[term[:-1]] = max(t, longer.get(term[:-1], 0))
    # A stem makes way for a longer one that says nearly as much; what a chosen stem covers is left out.
    chosen: list[tuple[str, bool]] = []
    stems: set[str] = set()
    for (term, stem), t in sorted(good.items(), key=lambda x: (len(x[0][0]), not x[0][1], x[0][0])):
        if any(term[:k] in stems for k in STEMS):
            continue
        if stem and longer.get(term, 0) >= 0.9 * t:
            continue
        if stem and good.get((term, False), 0) >= 0.9 * t:
            continue  # a plain word, not a stem
        chosen.append((term, stem))
        if stem:
            stems.add(term)
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton's method with a ridge on all but the first."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        norm = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(norm, 1e-12))
        if norm < 1e-8:
            break
    return w


def _terms(text: str) -> set[tuple[str, bool]]:
    words = {w for w in _TOKEN.findall(text.lower()) if 3 <= len(w) <= 32 and w not in _QUOTES}
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}


class Model:
    def __init__(self, lexicon: Lexicon, context: dict[str, float], weights: np.ndarray):
        self.lexicon, self.context, self.weights = lexicon, context, weights

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, measured(text, self.lexicon, self.context)))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def _counted_once(rows: DataFrame) -> DataFrame:
    """(toxic, mark, doc_id, text): of near copies of one kind the row with the smallest doc_id."""

    def marked(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                words = Words(batch.column("text"))
                runs, first = shingles(words.keys(), words.first, 5)
                marks = [hashlib.md5(np.unique(runs[a:b])[:SKETCH].tobytes()).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_toxic"), batch.column("doc_id"), batch.column("text"), pa.array(marks, pa.binary())],
                    names=["toxic", "doc_id", "text", "mark"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = rows.select("_toxic", "doc_id", "text").mapInArrow(marked, f"toxic int, doc_id {kind}, text string, mark binary")
    least = marks.groupBy("toxic", "mark").agg(F.min(F.struct("doc_id", "text")).alias("least"))
    return least.select("toxic", "mark", F.col("least.doc_id").alias("doc_id"), F.col("least.text").alias("text"))


def _first_by_hash(labelled: DataFrame, n: int) -> DataFrame:
    """(_key, _toxic) of the `n` rows with the least hash of their key; of keys with one hash the smallest."""
    last = cut(labelled, "_hash", n)
    if last is None:
        return labelled.drop("_hash")
    edge, before = last
    order = Window.partitionBy("_hash").orderBy("_key")  # keys that share one 64-bit hash: hardly ever more than one
    ties = labelled.where(F.col("_hash") == edge).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n - before)
    return labelled.where(F.col("_hash") < edge).drop("_hash").unionByName(ties.drop("_hash", "_place"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn_from=None) -> Model:
    """Lexicon, context weights and regression from labelled documents; `learn_from` is a condition on labels' doc_id."""
    spark = docs.sparkSession
    ship(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if learn_from is not None:
        usable = usable.where(learn_from)
    labelled = usable.groupBy(F.col("doc_id").alias("_key")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    picked = _first_by_hash(materialise(labelled.withColumn("_hash", F.xxhash64("_key")), "toxic-labels"), sample)
    # At most `sample` rows of two numbers: small enough to broadcast at any size of the tables.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_key"))

    held = materialise(_counted_once(rows), "toxic-sample")
    kinds = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = kinds.get(1, 0), kinds.get(0, 0)
    if not toxic or not other:
        z = math.log((toxic + 0.5) / (other + 0.5)) if toxic + other else -3.0
        return Model(Lexicon([]), {}, np.array([z] + [0.0] * (N_FEATURES - 1)))

    def counted(batches):
        seen: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for term in _terms(text.as_py()):
                    seen.setdefault(term, [0, 0])[kind] += 1
                if len(seen) > 1_000_000:
                    yield given(seen)
                    seen = {}
        yield given(seen)

    def given(seen):
        terms = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()),
             pa.array([seen[x][1] for x in terms], pa.int64()), pa.array([seen[x][0] for x in terms], pa.int64())],
            names=["term", "stem", "t", "c"],
        )

    counts = held.select("toxic", "text").mapInArrow(counted, "term string, stem boolean, t long, c long")
    counts = counts.groupBy("term", "stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t + c >= 3")
    counts = materialise(counts, "toxic-terms")
    sizes = {r["k"]: r["n"] for r in counts.groupBy((F.col("t") + F.col("c")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    passes = beyond_chance(sizes, toxic, other)

    def tested(batches):
        for batch in batches:
            t, c = batch.column("t").to_pylist(), batch.column("c").to_pylist()
            yield batch.filter(pa.array([passes(*x) for x in zip(t, c, strict=True)], pa.bool_()))

    # The test itself bounds what is collected: every term that passes it is used, however many there are.
    likely = counts.select("term", "stem", "t", "c").mapInArrow(tested, "term string, stem boolean, t long, c long").collect()
    lexicon = Lexicon(choose([(r["term"], r["stem"], r["t"], r["c"]) for r in likely], sizes, toxic, other))

    def beside(batches):
        for batch in batches:
            seen = [Counter(), Counter()]
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for _, _, around in hits(text.as_py(), lexicon)[1]:
                    seen[kind].update(around)
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())],
                names=["w", "t", "c"],
            )

    around = held.select("toxic", "text").mapInArrow(beside, "w string, t long, c long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # A word tells apart only where both kinds of documents have hits; ten occurrences of each are added.
    around = around.where("c > 0").orderBy("w").collect()
    n_t, n_c = sum(r["t"] for r in around) + 10, sum(r["c"] for r in around) + 10
    context = {r["w"]: math.log((r["t"] + 10) / n_t) - math.log((r["c"] + 10) / n_c) for r in around}

    def described(batches):
        for batch in batches:
            rows = [measured(t.as_py(), lexicon, context) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    table = held.select("toxic", "text").mapInArrow(described, "toxic int, x array<double>").toArrow()
    x = np.array(table["x"].to_pylist(), np.float64).reshape(-1, N_FEATURES)
    # Rows in a fixed order, so that the sums of a rerun agree to the last bit.
    y = table["toxic"].to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))
    return Model(lexicon, context, logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from `limit` on) to every row of `docs`."""
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("score", "predicted")]

    def scored(batches):
        for batch in batches:
            values = [model.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in own)
    out = docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(scored, f"{kinds}, score double")
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))
