"""Search over words: TF-IDF cosine and BM25.

Both are a sum over the words a request and a unit share, of a weight on the side
of the request times one on the side of the unit.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import words as text_words
from colloquy.operators import inside
from colloquy.operators.blocks import block_by_block, hit_schema, parts_of, to_all_tasks
from colloquy.operators.encode import CorpusStats, request_terms
from colloquy.operators.joins import join_small
from colloquy.operators.ranking import largest_k, rank_hits
from colloquy.schemas import CHUNK_KEY, REQUEST_FILTERS
from colloquy.session import Size, measure

# Words of requests measured to be within these bounds are sent to every task.
WORDS = Size(rows=500_000, bytes=64 * 1024 * 1024)


Bm25 = tuple[float, float, float]  # k1, b, and the mean number of words per unit


def _searcher(key: Sequence[str], filters: Sequence[str], limit: int, bm25: Bm25 | None):
    """Two functions for use inside tasks: one that reads requests, one that searches batches for them.

    Units bring `terms` with their weights or, for BM25, the plain `words` of their
    text, of which only those that a request has are counted.
    """
    key, conditions_of = list(key), [c for c in filters if c != "k"]
    tile, pairs = inside.TILE, inside.PAIRS
    values, forbidden = inside.make_values(), inside.make_forbidden()
    start, candidates, offer, result = inside.make_keeper(key, limit)

    def read(table: pa.Table) -> dict:
        """Per word the requests that have it, and its weight in each."""
        ids, first, q = np.unique(values(table.column("req_id")), return_index=True, return_inverse=True)
        word = table.column("term").combine_chunks()
        word = (word.chunk(0) if isinstance(word, pa.ChunkedArray) else word).dictionary_encode()
        at = word.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        begins = np.searchsorted(at[order], np.arange(len(word.dictionary) + 1))
        return {
            "id": ids,
            "place": {term: i for i, term in enumerate(word.dictionary.to_pylist())},
            "begins": begins,
            "q": q[order],
            "weight": values(table.column("weight"))[order],
            "conditions": {c: table.column(c).take(pa.array(first)).to_pylist() for c in conditions_of},
        }

    def places(word: pa.DictionaryArray, place: dict) -> np.ndarray:
        known = np.array([place.get(term, -1) for term in word.dictionary.to_pylist()], dtype=np.int64)
        return known[word.indices.to_numpy()] if len(known) else known

    def weighted(lists: pa.ListArray, unit: np.ndarray, place: dict):
        """(unit, word, weight) of the words that a request has."""
        flat = lists.flatten()
        if bm25 is None:
            at = places(flat.field("term").dictionary_encode(), place)
            known = at >= 0
            return unit[known], at[known], values(flat.field("weight"))[known]
        at = places(flat.dictionary_encode(), place)
        known = at >= 0
        cell, tf = np.unique(unit[known] * len(place) + at[known], return_counts=True)
        of, at = np.divmod(cell, max(1, len(place)))
        length = np.bincount(unit, minlength=len(lists))[of]
        k1, b, mean = bm25
        return of, at, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    def search(asked: dict, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
        n_asked = len(asked["id"])
        state = start(n_asked)
        for batch in batches:
            lists = batch.column("words" if bm25 else "terms")
            unit = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            unit, at, weight = weighted(lists, unit, asked["place"])
            count = asked["begins"][at + 1] - asked["begins"][at]
            keys = {c: values(batch.column(c)) for c in key}
            roles = values(batch.column("role")) if "roles" in conditions_of else None
            step = max(1, tile // max(1, n_asked))
            first = np.searchsorted(unit, np.arange(len(lists) + 1))
            met = np.append(0, np.cumsum(count))[first]  # pairs of words before each unit
            hi = 0
            while hi < len(lists):  # units are taken while their scores and pairs fit, one at least
                lo, hi = hi, min(len(lists), hi + step)
                hi = max(lo + 1, min(hi, int(np.searchsorted(met, met[lo] + pairs, side="right")) - 1))
                n, a, b = hi - lo, first[lo], first[hi]
                if a == b:
                    continue
                total = count[a:b]
                within = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
                pair = np.repeat(asked["begins"][at[a:b]], total) + within
                cell = np.repeat(unit[a:b] - lo, total) * n_asked + asked["q"][pair]
                part = np.repeat(weight[a:b], total) * asked["weight"][pair]
                scores = np.bincount(cell, weights=part, minlength=n * n_asked).reshape(n, n_asked)
                scores[scores <= 0] = -np.inf  # no word in common
                if conditions_of:
                    convs = keys["conv_id"][lo : lo + n] if "conv_id" in keys else None
                    said = roles[lo : lo + n] if roles is not None else None
                    scores[forbidden(asked["conditions"], 0, n_asked, n, convs, said)] = -np.inf
                row, col = candidates(scores, state["floor"])
                offer(state, col, {c: keys[c][row + lo] for c in key}, scores[row, col])
        return result(state, asked["id"])

    return read, search


def _best(
    asked: DataFrame, units: DataFrame, k: int, key: list[str], bm25: Bm25 | None, words: Size
) -> DataFrame:
    """Send requests whose words fit to all tasks; cut more than that into blocks of half as many."""
    filters = [c for c in REQUEST_FILTERS if c in asked.columns]
    size, limit = measure(asked), largest_k(asked, k)
    read, search = _searcher(key, filters, limit, bm25)
    schema = hit_schema(asked, units, key)
    parts = parts_of(size, words, limit)
    if parts <= 1 and size.within(words.rows, words.bytes):
        scored = to_all_tasks(asked, units, read, search, schema)
    else:
        scored = block_by_block(asked, units, read, search, schema, 2 * parts)
    if "k" in filters:
        own = asked.groupBy("req_id").agg(F.max("k").alias("k"))
        scored = join_small(scored, own, ["req_id"], spread_by=key, size=size)
    return rank_hits(scored, key, k, limit)


def _sides(asked: DataFrame, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    filters = [c for c in REQUEST_FILTERS if c in asked.columns]
    roles = ["role"] if "roles" in filters and "role" not in key else []
    return asked.select("req_id", "term", "weight", *filters), [*key, *roles]


def term_search(
    request_vectors: DataFrame,
    unit_vectors: DataFrame,
    k: int,
    key: Sequence[str] = CHUNK_KEY,
    words: Size = WORDS,
) -> DataFrame:
    """Top-k by TF-IDF cosine, of `encode.tfidf_requests` over `encode.tfidf_rows`.

    Products of unit vectors add up to the cosine. All weights are positive, so a
    sum of 0 means no common word. No pair leaves a task unless it may be a hit.
    """
    asked, needs = _sides(request_vectors, key)
    pair = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["weight"].alias("weight")))
    return _best(asked, unit_vectors.select(*needs, pair.alias("terms")), k, list(key), None, words)


def bm25_search(
    requests: DataFrame,
    units: DataFrame,
    k: int,
    stats: CorpusStats,
    k1: float = 1.2,
    b: float = 0.75,
    key: Sequence[str] = CHUNK_KEY,
    words: Size = WORDS,
) -> DataFrame:
    """Top-k by BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a repeated word of a request counts again.

    Needs no weights of the other words of a unit, so the text is not shuffled at
    all while the requests are few enough to be sent to the tasks.
    """
    n = F.lit(stats.n_units)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked, needs = _sides(request_terms(requests, stats).withColumn("weight", F.col("tf") * idf), key)
    mean = stats.n_words / stats.n_units if stats.n_units else 1.0
    said = units.select(*needs, text_words(F.coalesce("text", F.lit(""))).alias("words"))
    return _best(asked, said, k, list(key), (k1, b, mean), words)
