"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class). A word's class follows from its last
two bytes: the `CLASSES` - 17 endings with most words have a class each, the others share 16,
the end of a text has its own. P(class | before) is a maximum-entropy model over hashed
features: the word before (bigram), the one before that (skip), and both together (trigram).
P(word | class) has the words' own features only; its maximum-likelihood weights are the
counts, smoothed as in the base score, with one event for all unknown words of the class.

Training: a pass counts all words of the training texts, another the classes after each pair
of context buckets. These counts, at most CONTEXTS ** 2 * CLASSES cells however large the
corpus is, are all that the gradient needs, since it is the difference of counted and expected
features. Every update is a Spark job over the cells; the model is a few MB at any size.

Scoring: a pass in numpy over batches; of each batch only the contexts that occur are looked
up. The `HEAD` most frequent words go to every task; other words leave the task as
(row, word, count) and meet their counts in a join, so a vocabulary of any size works.

Results in special cases: null and empty texts are the end token alone; texts are lower-cased
in A-Z only; a null doc_id is never held out, and learnt from; repeated rows count and are
scored each; without training texts all words are unknown. An empty table gives an empty
result. Other columns are kept, whatever their names, but columns named as the results are replaced. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.cuts import cut
from colloquy.llm.ship import ship
from colloquy.llm.words import Words, by_bytes
from colloquy.session import materialise

CLASSES = 64
SHARED = 16  # classes for all rarer endings
OWN = 127  # words with a context bucket each; others share one per class
CONTEXTS = 1 + OWN + CLASSES  # bucket 0 stands before a text
TRIGRAMS = 1 << 14
HEAD = 200_000  # words known to every task: 4 MB
UPDATES = 10
PRIOR = 2.0  # added to expected counts: rare features move little
PARTS = 12  # tasks of an update
FLUSH = 1_000_000
_SLOTS = 20  # bits of a place in the table of head words
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _codes(words: Words) -> np.ndarray:
    """The last two bytes of every word, as a number."""
    last = _LOWER[words.raw[words.end - 1]]
    before = _LOWER[words.raw[np.maximum(words.end - 2, 0)]]
    return np.where(words.end - words.start > 1, before, 0) * 256 + last


class Head:
    """The most frequent words in two tables of slots; a word that finds both its slots taken is left to the join."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.slot = [np.full(1 << _SLOTS, -1, np.int32) for _ in range(2)]
        left = np.arange(len(keys), dtype=np.int32)  # most frequent first
        for table, shift in zip(self.slot, (64 - _SLOTS, 64 - 2 * _SLOTS), strict=True):
            at = self._place(keys[left], shift)
            _, firsts = np.unique(at, return_index=True)
            table[at[firsts]] = left[firsts]
            left = np.delete(left, firsts)
        self.keys = np.append(keys, np.uint64(0))
        self.counts = np.append(counts.astype(np.float64), 0.0)
        self.log = np.log10(self.counts + 0.5)

    @staticmethod
    def _place(keys: np.ndarray, shift: int) -> np.ndarray:
        return ((keys >> np.uint64(shift)) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each word among the head words, or -1."""
        first = self.slot[0][self._place(keys, 64 - _SLOTS)]
        second = self.slot[1][self._place(keys, 64 - 2 * _SLOTS)]
        found = np.where(self.keys[first] == keys, first, second)
        return np.where((found >= 0) & (self.keys[found] == keys), found, -1)


class Reader:
    """Classes and contexts of the tokens of a batch; tokens of a row are its words and its end."""

    def __init__(self, head: Head, class_of: np.ndarray):
        self.head, self.class_of = head, class_of

    def read(self, texts: pa.Array):
        words = Words(texts)
        keys = words.keys()
        rank = self.head.find(keys)
        kind = self.class_of[_codes(words)].astype(np.int64)
        bucket = np.where((rank >= 0) & (rank < OWN), rank + 1, 1 + OWN + kind)
        # Tokens: the words of each row, then its end.
        first = words.first + np.arange(words.rows + 1)
        n = first[-1]
        is_word = np.ones(n, dtype=bool)
        is_word[first[1:] - 1] = False
        classes = np.zeros(n, np.int64)  # class 0 is the end
        classes[is_word] = kind
        own = np.zeros(n, np.int64)
        own[is_word] = bucket
        one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        one[1:], two[2:] = own[:-1], own[:-2]
        one[first[:-1]] = 0
        two[first[:-1]] = 0
        second = first[:-1] + 1
        two[second[second < first[1:]]] = 0
        return keys, rank, classes, two * CONTEXTS + one, is_word, first


def features(context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the three weight tables that a context turns on."""
    two, one = np.divmod(context, CONTEXTS)
    with np.errstate(over="ignore"):
        mixed = (context.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return one, two, (mixed >> np.uint64(64 - 14)).astype(np.int64)


def log_probabilities(weights: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    """ln P(class | context), a row per context."""
    z = sum(w[f].astype(np.float64) for w, f in zip(weights, features(context), strict=True))
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, code, c): how often each word occurs; added up in the task before the shuffle."""

    def counted(batches):
        held, size = [], 0
        for whole in batches:
            for batch in by_bytes(whole, text):
                words = Words(batch.column(text))
                keys, at, c = np.unique(words.keys(), return_index=True, return_counts=True)
                held.append((keys, _codes(words)[at] if len(keys) else np.empty(0, np.int64), c))
                size += len(keys)
                if size > FLUSH:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield _as_batch(held[0])
                        held, size = [], 0
        if held:
            yield _as_batch(_added(held))

    counts = docs.select(text).mapInArrow(counted, "key long, code int, c long")
    return counts.groupBy("key").agg(F.min("code").alias("code"), F.sum("c").alias("c"))


def _added(held):
    keys = np.concatenate([h[0] for h in held])
    distinct, at, where = np.unique(keys, return_index=True, return_inverse=True)
    codes = np.concatenate([h[1] for h in held])[at]
    return distinct, codes, np.bincount(where, weights=np.concatenate([h[2] for h in held]), minlength=len(distinct)).astype(np.int64)


def _as_batch(part):
    keys, codes, c = part
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(codes.astype(np.int32)), pa.array(c)], names=["key", "code", "c"]
    )


class Model:
    """What a task needs: head words, classes of endings, weights, and the totals of every class."""

    def __init__(self, head: Head, class_of: np.ndarray, ends: int, totals: np.ndarray, kinds: np.ndarray):
        self.reader = Reader(head, class_of)
        self.ends, self.totals, self.kinds = ends, totals, kinds
        self.weights: list[np.ndarray] = []

    @property
    def tokens(self) -> int:
        return int(self.totals.sum())


def _classes(by_code: dict[int, tuple[int, int]]) -> np.ndarray:
    """Class of every ending; class 0 is left to the end of a text."""
    codes = np.arange(1 << 16)
    class_of = (CLASSES - SHARED + codes * 40503 % (1 << 16) * SHARED // (1 << 16)).astype(np.uint8)
    for place, code in enumerate(sorted(by_code, key=lambda x: (-by_code[x][0], x))[: CLASSES - SHARED - 1]):
        class_of[code] = place + 1
    return class_of


def _cells(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(context, kind, n): how often each class follows each pair of context buckets, over all texts."""
    reader = docs.sparkSession.sparkContext.broadcast(model.reader)

    def counted(batches):
        cells = np.zeros(CONTEXTS * CONTEXTS * CLASSES, np.int64)
        for whole in batches:
            for batch in by_bytes(whole, text):
                _, _, classes, context, _, _ = reader.value.read(batch.column(text))
                np.add.at(cells, context * CLASSES + classes, 1)
        found = np.flatnonzero(cells)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], names=["cell", "n"])

    sums = docs.select(text).mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return sums.select(
        F.floor(F.col("cell") / CLASSES).cast("int").alias("context"), F.pmod("cell", F.lit(CLASSES)).cast("int").alias("kind"), "n"
    )


def _gradient(cells: DataFrame, weights: list[np.ndarray] | None) -> list[np.ndarray]:
    """Counted features, less expected ones if there are weights: one row per task and table, and the touched rows of trigrams."""
    sent = cells.sparkSession.sparkContext.broadcast(weights)

    def partial(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        context, kind, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        distinct, at = np.unique(context, return_inverse=True)
        value = np.bincount(at * CLASSES + kind, weights=n, minlength=len(distinct) * CLASSES).reshape(-1, CLASSES)
        if sent.value is not None:
            value = value - value.sum(1, keepdims=True) * np.exp(log_probabilities(sent.value, distinct))
        for table, (rows, size) in enumerate(zip(features(distinct), (CONTEXTS, CONTEXTS, TRIGRAMS), strict=True)):
            touched, where = np.unique(rows, return_inverse=True)
            sums = np.zeros((len(touched), CLASSES))
            np.add.at(sums, where, value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([table], pa.int32()), pa.array([touched.astype(np.int32).tobytes()]), pa.array([sums.astype(np.float32).tobytes()])],
                names=["t", "rows", "sums"],
            )

    out = [np.zeros((size, CLASSES)) for size in (CONTEXTS, CONTEXTS, TRIGRAMS)]
    for row in cells.mapInArrow(partial, "t int, rows binary, sums binary").orderBy("t", "rows").toLocalIterator():
        rows = np.frombuffer(row["rows"], np.int32)
        out[row["t"]][rows] += np.frombuffer(row["sums"], np.float32).reshape(-1, CLASSES)
    sent.unpersist()
    return out


def _most_frequent(words: DataFrame, n: int) -> DataFrame:
    """The `n` words with the largest c, of equal ones those with the smallest keys; `words` is a written table."""
    rows = words.withColumn("_less", -F.col("c"))
    most = cut(rows, "_less", n)
    if most is None:
        return words
    less, before = most
    ties = rows.where(F.col("_less") == less)
    last = cut(ties, "key", n - before)
    chosen = F.col("_less") <= less if last is None else (F.col("_less") < less) | ((F.col("_less") == less) & (F.col("key") <= last[0]))
    return rows.where(chosen).drop("_less")


def train(docs: DataFrame, text: str = "text", updates: int = UPDATES) -> tuple[Model, DataFrame]:
    """The model of all texts of `docs`, and the table (key, c) of their words."""
    spark = docs.sparkSession
    ship(spark)
    words = materialise(count_words(docs, text), "words")
    ends = docs.count()
    by_code = {r["code"]: (r["c"], r["n"]) for r in words.groupBy("code").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    class_of = _classes(by_code)  # at most 65,536 endings
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    totals[0], kinds[0] = ends, int(ends > 0)
    for code, (c, n) in by_code.items():
        totals[class_of[code]] += c
        kinds[class_of[code]] += n
    top = _most_frequent(words.select("key", "c"), HEAD).toArrow()
    order = np.lexsort((top["key"].to_numpy(), -top["c"].to_numpy()))
    head = Head(top["key"].to_numpy()[order].view(np.uint64), top["c"].to_numpy()[order])
    model = Model(head, class_of, ends, totals, kinds)
    cells = materialise(_cells(docs, model, text).repartition(PARTS, "context"), "cells")
    counted = _gradient(cells, None)
    # Start from the bigram model, then add what skips and trigrams tell.
    prior = (counted[0].sum(0) + 1) / (counted[0].sum() + CLASSES)
    start = np.log((counted[0] + 5 * prior) / (counted[0].sum(1, keepdims=True) + 5))
    weights = [start, np.zeros((CONTEXTS, CLASSES)), np.zeros((TRIGRAMS, CLASSES))]
    for _ in range(updates):
        slope = _gradient(cells, [w.astype(np.float32) for w in weights])
        for w, g, o in zip(weights, slope, counted, strict=True):
            # Expected counts are the curvature's bound; three features are on at once.
            w += np.clip(g / (np.maximum(o - g, 0) + PRIOR) / 3, -1, 1)
    model.weights = [w.astype(np.float32) for w in weights]
    return model, words.select("key", "c")


def score(docs: DataFrame, model: Model, words: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to `docs`, less its text."""
    spark = docs.sparkSession
    ship(spark)
    replaced = {text, "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    own = {f"_own{i}": c for i, c in enumerate(docs.columns) if c not in replaced}  # numbered: no name of theirs can be one of ours
    sent = spark.sparkContext.broadcast(model)
    end_log = float(np.log10(model.ends + 0.5))
    share = np.log10(model.totals + 0.5 * (model.kinds + 1))

    def scored(batches):
        m = sent.value
        for whole in batches:
            for batch in by_bytes(whole, "_text"):
                keys, rank, classes, context, is_word, first = m.reader.read(batch.column("_text"))
                # Only the contexts of this batch get their class probabilities.
                distinct, at = np.unique(context, return_inverse=True)
                by_class = log_probabilities(m.weights, distinct) / np.log(10)
                value = by_class[at, classes] - share[classes]
                known = np.full(len(classes), end_log)
                known[is_word] = np.where(rank >= 0, m.reader.head.log[rank], 0.0)
                sums = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
                in_head = np.full(len(classes), int(m.ends > 0))
                in_head[is_word] = rank >= 0
                tail = np.flatnonzero(rank < 0)
                row = np.repeat(np.arange(batch.num_rows), np.diff(first) - 1)[tail]
                order = np.lexsort((keys[tail], row))
                row, rare = row[order], keys[tail][order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (rare[1:] != rare[:-1]) | (row[1:] != row[:-1])
                begins = np.flatnonzero(new)
                times = np.diff(np.append(begins, len(rare)))
                offsets = pa.array(np.searchsorted(row[begins], np.arange(batch.num_rows + 1)).astype(np.int32))
                columns = [batch.column(c) for c in own]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(first)), pa.array(sums(in_head).astype(np.int64)), pa.array(sums(known)), pa.array(sums(value)),
                     pa.ListArray.from_arrays(offsets, pa.array(rare[begins].view(np.int64))),
                     pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                    names=[*own, "n_tokens", "_known", "_log", "_class", "_rare", "_times"],
                )

    kinds = "".join(f"{name} {docs.schema[c].dataType.simpleString()}, " for name, c in own.items())
    slim = docs.select(*[F.col(f"`{c}`").alias(name) for name, c in own.items()], F.col(f"`{text}`").alias("_text"))
    out = slim.mapInArrow(
        scored, f"{kinds}n_tokens long, _known long, _log double, _class double, _rare array<long>, _times array<int>"
    )
    rows = materialise(out.withColumn("_row", F.monotonically_increasing_id()), "scored")  # numbered once, in a table
    rare = rows.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("r")).select("_row", F.col("r._rare").alias("key"), F.col("r._times").alias("t"))
    met = rare.join(words, "key", "left").groupBy("_row").agg(
        F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_rare_log"),
        F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("_rare_known"),
    )
    whole = rows.drop("_rare", "_times").join(met, "_row", "left")
    logs = F.col("_log") + F.coalesce("_rare_log", F.lit(0.0))
    n, v = model.tokens, int(model.kinds.sum())
    return whole.select(
        *[F.col(name).alias(c) for name, c in own.items()], "n_tokens",
        (F.col("_known") + F.coalesce("_rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (logs + F.col("_class")).alias("score"),
    )
