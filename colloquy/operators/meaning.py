"""Meaning from context: word vectors by random indexing, and passages as weighted sums of them.

Every word has an index vector: +1 or -1 in one of `dim` places, by its md5. A word's context
vector is the sum of the index vectors of all words within `window` places of it, over all
utterances. These are sums of integers, so any cut into tasks and any order gives the same
bits, and no vocabulary is held in one place. Words used alike get vectors alike.
"""

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import words
from colloquy.operators import inside
from colloquy.operators.encode import CorpusStats, tfidf_requests
from colloquy.schemas import CHUNK_KEY, REQUEST_FILTERS
from colloquy.session import BROADCAST_BYTES, BROADCAST_ROWS, Size, materialise, measure

DIM = 64
WINDOW = 2
SMALL = Size(BROADCAST_ROWS, BROADCAST_BYTES)


# Counts of a word side by side: the places `at` they belong to, ascending, and how much they are, `n`. None is 0.
LISTED = "term string, at array<int>, n array<long>"


def _make_listed():
    def listed(terms: pa.Array, code: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """LISTED rows, one per term that has any, of counts `n` at places `at` of the terms `code`; summed up as integers."""
        low = int(at.min()) if len(at) else 0
        width = int(at.max()) - low + 1 if len(at) else 1
        entry = code.astype(np.int64) * width + (at - low)
        order = np.argsort(entry, kind="stable")
        entry, n = entry[order], n[order]
        begins = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]][: len(entry)])
        entry, n = entry[begins], np.add.reduceat(n, begins) if len(begins) else n
        entry, n = entry[n != 0], n[n != 0]
        code = entry // width
        begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        offsets = pa.array(np.r_[begins, len(code)].astype(np.int32))
        columns = [terms.take(pa.array(code[begins]))]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((entry % width + low).astype(np.int32), n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "at", "n"])

    return listed


def _merged(lists: DataFrame) -> DataFrame:
    """LISTED rows, one per term: what tasks have counted meets by term, in the order of terms, and is summed up run by run.

    A task holds a batch and the last word of the one before. A word comes at most once per batch counted, so no word is many rows.
    """
    listed = _make_listed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = listed(pa.array([], pa.string()), *(np.zeros(0, dtype=np.int64) for _ in range(3)))
        for batch in batches:
            both = (held, batch)
            coded = pa.concat_arrays([b.column("term") for b in both]).dictionary_encode(null_encoding="encode")
            sizes = np.concatenate([np.diff(b.column("at").offsets.to_numpy()) for b in both])
            at, n = (np.concatenate([b.column(c).flatten().to_numpy() for b in both]) for c in ("at", "n"))
            out = listed(coded.dictionary, np.repeat(coded.indices.to_numpy(), sizes), at, n)
            # The last word may go on in the next batch.
            last = max(0, out.num_rows - 1)
            yield out.slice(0, last)
            held = pa.RecordBatch.from_arrays([c.take(pa.array(range(last, out.num_rows), pa.int64())) for c in out.columns], names=out.schema.names)
        yield held

    return lists.repartition("term").sortWithinPartitions("term").mapInArrow(merge, LISTED)


def _rows(lists: DataFrame) -> DataFrame:
    """LISTED rows as (term, bucket, value)."""
    return lists.select("term", F.inline(F.arrays_zip(F.col("at").alias("bucket"), F.col("n").alias("value")))).toDF("term", "bucket", "value")


def _lists(counts: DataFrame) -> DataFrame:
    """Rows (term, bucket, value) as LISTED ones, one per term."""
    listed = _make_listed()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("term").dictionary_encode(null_encoding="encode")
            yield listed(coded.dictionary, coded.indices.to_numpy(), batch.column("bucket").to_numpy(), batch.column("value").to_numpy())

    long_value = F.col("value").cast("long").alias("value")
    return _merged(counts.select("term", "bucket", long_value).mapInArrow(pack, LISTED))


def _context_parts(utterances: DataFrame, dim: int, window: int) -> DataFrame:
    """LISTED rows of the context vectors as far as a task has met them. A word's index vector is made once per batch:
    8 hex digits of its md5 modulo dim, + if the next 4 are even."""
    said = utterances.select(words(F.coalesce("text", F.lit(""))).alias("_words"))
    listed, most = _make_listed(), inside.PAIRS

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_words")
            coded = lists.flatten().dictionary_encode()
            digests = [md5(word.encode()).hexdigest() for word in coded.dictionary.to_pylist()]
            bucket = np.array([int(d[:8], 16) % dim for d in digests], dtype=np.int64)
            sign = np.array([1 - 2 * (int(d[8:12], 16) % 2) for d in digests], dtype=np.int64)
            code = coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            for lo in range(0, len(code), most):  # words lo.. of the batch, with those beside them on the right
                pairs = []
                for o in range(1, window + 1):
                    left = np.arange(lo, max(lo, min(lo + most, len(code) - o)))
                    left = left[row[left] == row[left + o]]
                    pairs += [(code[left], code[left + o]), (code[left + o], code[left])]
                of, near = (np.concatenate(side) for side in zip(*pairs))
                yield listed(coded.dictionary, of, bucket[near], sign[near])

    return said.mapInArrow(beside, LISTED)


def context_entries(utterances: DataFrame, dim: int = DIM, window: int = WINDOW) -> DataFrame:
    """(term, at, n): the non-zero entries of all context vectors, side by side. Summed up in the task before the shuffle."""
    return _merged(_context_parts(utterances, dim, window))


def context_counts(utterances: DataFrame, dim: int = DIM, window: int = WINDOW) -> DataFrame:
    """(term, bucket, value): the same, a row each."""
    return _rows(context_entries(utterances, dim, window))


def _with_df(stats: CorpusStats, vectors: DataFrame) -> DataFrame:
    """(term, df, at, n) of all words that have a frequency or a context."""
    if "df" in vectors.columns:
        return vectors.select("term", "df", "at", "n")
    empty = lambda c: F.coalesce(c, F.array().cast(vectors.schema[c].dataType)).alias(c)
    return vectors.join(stats.table, "term", "full").select("term", F.coalesce("df", F.lit(0)).alias("df"), empty("at"), empty("n"))


def word_vectors(counts: DataFrame, dim: int = DIM, stats: CorpusStats | None = None) -> DataFrame:
    """(term, at, n): context vectors by their entries, as a written table; with `stats` also df, and all words of these.

    `counts` are entries, or rows as `context_counts` gives them, of which those with a bucket below `dim` count.

    A rare word has few entries, so what a large vocabulary adds is a few numbers a word, and not `dim`.
    """
    made = counts if "at" in counts.columns else _lists(counts.filter(F.col("bucket") < dim))
    return materialise(_with_df(stats, made) if stats else made, "word-vectors")


# --- passages and requests ---------------------------------------------------------------


def _make_fold(dim: int, n_units: int | None):
    """Two functions for use inside tasks: one that spreads entries out to unit vectors, one that sums them up by row.

    With `n_units` weights are counts of words, which become TF-IDF of length 1; otherwise they are used as they are.
    """
    tile = inside.TILE // dim

    def spread_out(first: np.ndarray, count: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        begin = np.cumsum(count) - count
        source = np.arange(count.sum()) + np.repeat(first - begin, count)
        matrix = np.zeros((len(first), dim))
        matrix[np.repeat(np.arange(len(first)), count), at[source]] = n[source]
        length = np.sqrt((matrix * matrix).sum(axis=1))
        return matrix / np.where(length > 0, length, 1)[:, None]

    def fold(n_rows: int, row: np.ndarray, weight: np.ndarray, df: np.ndarray, word: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """(n_rows, dim); `row` ascends, and `word` is the place of a vector in `matrix`."""
        if n_units is not None:
            weight = (np.log(weight) + 1) * (np.log((n_units + 1) / (df + 1)) + 1)
            weight = weight / np.sqrt(np.bincount(row, weights=weight * weight, minlength=n_rows))[row]
        out = np.zeros((n_rows, dim))
        starts = np.searchsorted(row, np.arange(n_rows + 1))
        lo = 0
        while lo < n_rows:  # whole rows at a time, so that sums do not depend on what else is in the batch
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + tile, "right")) - 1)
            part = slice(starts[lo], starts[hi])
            if starts[hi] > starts[lo]:
                begins = np.flatnonzero(np.r_[True, row[part][1:] != row[part][:-1]])
                out[row[part][begins]] = np.add.reduceat(weight[part, None] * matrix[word[part]], begins)
            lo = hi
        return out

    return spread_out, fold


def _vec_column(dim: int):
    def vec_column(out: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.reshape(-1)))

    return vec_column


def _least_df(known: DataFrame, stats: CorpusStats, small: Size) -> tuple[int, str]:
    """Words in at least so many units go to all tasks: as many as `small` takes, by levels of frequency, and the hot ones in any case.

    Also the type that all counts fit into.
    """
    widest = F.max(F.greatest(F.array_max("n"), -F.array_min("n")))
    levels = known.groupBy(F.length(F.bin("df")).alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("term")).alias("b"), F.sum(F.size("at")).alias("entries"), widest.alias("widest")
    ).collect()
    kind = "int" if max([r["widest"] or 0 for r in levels], default=0) < 1 << 31 else "bigint"
    least, n, size = stats.hot_df(), 0, 0
    for row in sorted(levels, key=lambda r: -r["level"]):  # 64 levels at most
        n, size = n + row["words"], size + row["b"] + 20 * row["words"] + (6 if kind == "int" else 10) * row["entries"]
        if not Size(n, size).within(small.rows, small.bytes):
            return least, kind
        least = min(least, 1 << (row["level"] - 1))
    return 0, kind


def _summed(rows: DataFrame, known: DataFrame, key: Sequence[str], dim: int, small: Size, stats: CorpusStats, weigh: bool) -> DataFrame:
    """`rows` with `terms` (term, weight), or words to `weigh`, become rows with `vec`, the weighted sum of their words' vectors.

    `known` is (term, df, at, n). As many of the most frequent words as `small` takes are sent to all tasks. If these are all,
    nothing is shuffled. Others, which are rare and so have few entries, meet the words of rows in a join; rows and what they
    have of these are put together again. With `weigh` weights are TF-IDF, and rows without a known word are left out.
    """
    rest = [c for c in rows.columns if c != "terms"]
    least, kind = _least_df(known, stats, small)
    known = known.select("term", "df", F.col("at").cast("array<smallint>" if dim < 1 << 15 else "array<int>"), F.col("n").cast(f"array<{kind}>"))
    shared = rows.sparkSession.sparkContext.broadcast(known.filter(F.col("df") >= least).toArrow())
    places, whole, vec_column = inside.make_places(), inside.make_whole(), _vec_column(dim)
    spread_out, fold = _make_fold(dim, stats.n_units if weigh else None)
    made = T.StructType([*[rows.schema[c] for c in rest], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def table_of():
        columns = {c: whole(shared.value.column(c)) for c in ("term", "df", "at", "n")}
        offsets = columns["at"].offsets.to_numpy()
        return columns["term"], columns["df"].to_numpy(), offsets[:-1], np.diff(offsets), *(columns[c].values.to_numpy() for c in ("at", "n"))

    def looked_up(batch: pa.RecordBatch, terms: pa.Array):
        """Row, weight and code of all words of a batch, in the order of words if they are counted here; per code place and word."""
        lists = batch.column("terms")
        flat = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        coded = (flat if weigh else flat.field("term")).dictionary_encode()
        named, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        if not weigh:
            return row, flat.field("weight").to_numpy(), code, places(named, terms), named
        order = pc.sort_indices(named)
        rank = np.empty(len(named), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(named))
        found, tf = np.unique(row * max(1, len(named)) + rank[code], return_counts=True)
        row, code = np.divmod(found, max(1, len(named)))
        named = named.take(order)
        return row, tf.astype(np.float64), code, places(named, terms), named

    def fold_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, first, count, at, n = table_of()
        for batch in batches:
            row, weight, code, place, _ = looked_up(batch, terms)
            met = np.where(place >= 0, place, 0) if len(terms) else np.zeros(len(place), dtype=np.int64)
            keep = place[code] >= 0
            row, weight, code = row[keep], weight[keep], code[keep]
            matrix = spread_out(first[met], count[met], at, n) if len(terms) else np.zeros((len(place), dim))
            vec = fold(batch.num_rows, row, weight, df[met[code]] if len(code) else weight, code, matrix)
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], vec_column(vec)], names=[*rest, "vec"])
            yield out.filter(pa.array(np.bincount(row, minlength=batch.num_rows) > 0)) if weigh else out

    if least == 0:
        return rows.mapInArrow(fold_known, made)

    cold = T.StructType().add("i", "integer").add("term", "string").add("weight", "double")
    parted = T.StructType([*[rows.schema[c] for c in rest], T.StructField("_at", T.ArrayType(T.IntegerType()))])
    parted = parted.add("_weight", T.ArrayType(T.DoubleType())).add("_rare", T.ArrayType(cold))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, *_ = table_of()
        for batch in batches:
            row, weight, code, place, named = looked_up(batch, terms)
            found = place[code]
            order = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)
            ends = lambda use: pa.array(np.searchsorted(row[use], np.arange(batch.num_rows + 1)).astype(np.int32))
            hot, rare = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
            others = pa.StructArray.from_arrays([pa.array(order[rare]), named.take(pa.array(code[rare])), pa.array(weight[rare])], names=["i", "term", "weight"])
            columns = [
                pa.ListArray.from_arrays(ends(hot), pa.array(found[hot].astype(np.int32))),
                pa.ListArray.from_arrays(ends(hot), pa.array(weight[hot])),
                pa.ListArray.from_arrays(ends(rare), others),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *columns], names=[*rest, "_at", "_weight", "_rare"])

    def fold_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, df, first, count, at, n = table_of()
        for batch in batches:
            rows_of = lambda lists: np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            hot, parts = batch.column("_at"), batch.column("_parts")
            flat = parts.flatten()
            by_place = np.lexsort([flat.field("i").to_numpy(), rows_of(parts)])
            here = flat.field("at")
            offsets = here.offsets.to_numpy()
            use, own = np.unique(hot.flatten().to_numpy(), return_inverse=True)
            matrix = np.concatenate([
                spread_out(first[use], count[use], at, n),
                spread_out(offsets[:-1], np.diff(offsets), here.values.to_numpy(), flat.field("n").values.to_numpy()),
            ])
            row = np.concatenate([rows_of(hot), rows_of(parts)[by_place]])
            order = np.argsort(row, kind="stable")
            weight = np.concatenate([batch.column("_weight").flatten().to_numpy(), flat.field("weight").to_numpy()[by_place]])
            known_df = np.concatenate([df[use][own], flat.field("df").to_numpy()[by_place]])
            vec = fold(batch.num_rows, row[order], weight[order], known_df[order], np.concatenate([own, len(use) + by_place])[order], matrix)
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], vec_column(vec)], names=[*rest, "vec"])
            yield out.filter(pa.array(np.bincount(row, minlength=batch.num_rows) > 0)) if weigh else out

    split = materialise(rows.mapInArrow(part, parted), "split-words")
    rare = known.filter(F.col("df") < least).hint("shuffle_merge")
    joined = split.select(*key, F.inline("_rare")).join(rare, "term")
    parts = joined.groupBy(*key).agg(F.collect_list(F.struct("i", "weight", "df", "at", "n")).alias("_parts"))
    both = split.drop("_rare").join(parts, list(key), "left")
    none = F.array().cast(parts.schema["_parts"].dataType)
    return both.withColumn("_parts", F.coalesce("_parts", none)).mapInArrow(fold_both, made)


def meaning_vectors(
    units: DataFrame, stats: CorpusStats, vectors: DataFrame, dim: int = DIM, key: Sequence[str] = CHUNK_KEY, small: Size = SMALL
) -> DataFrame:
    """Units with the sum of their words' vectors, weighted by TF-IDF, instead of the text."""
    rest = [c for c in units.columns if c != "text"]
    rows = units.select(*rest, words(F.coalesce("text", F.lit(""))).alias("terms"))
    return _summed(rows, _with_df(stats, vectors).filter("df > 0"), key, dim, small, stats, True)


def meaning_requests(requests: DataFrame, stats: CorpusStats, vectors: DataFrame, dim: int = DIM, small: Size = SMALL) -> DataFrame:
    """Requests as vectors, weighted by the statistics of the store they are asked of."""
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    terms = tfidf_requests(requests, stats)
    listed = F.sort_array(F.collect_list(F.struct("term", "weight")))
    rows = terms.groupBy("req_id").agg(*[F.first(c).alias(c) for c in filters], listed.alias("terms"))
    named = terms.select("term").distinct()
    known = _with_df(stats, vectors)
    if measure(named).within(small.rows, small.bytes):  # no more vectors than words are needed, however many there are
        known = materialise(known.join(F.broadcast(named), "term", "left_semi"), "request-vectors")
    return _summed(rows, known, ["req_id"], dim, small, stats, False)


# --- the model as a table ----------------------------------------------------------------

# Places of a term's row of counts beside its context: the units it is in. The counts of the whole corpus have no term.
DF, UNITS, WORDS = -1, -1, -2
MODEL = T.StructType().add("term", "string").add("bucket", "integer").add("value", "long")


def _model_parts(utterances: DataFrame, units: DataFrame, dim: int, window: int) -> DataFrame:
    """LISTED rows of what tasks have counted: contexts, and units and words of units."""
    said = units.select(words(F.coalesce("text", F.lit(""))).alias("_words"))
    listed, df, n_units, n_words = _make_listed(), DF, UNITS, WORDS

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("_words").offsets.to_numpy())
            coded = batch.column("_words").flatten().dictionary_encode()
            many = len(coded.dictionary)
            once = np.unique(np.repeat(np.arange(batch.num_rows), sizes) * max(1, many) + coded.indices.to_numpy()) % max(1, many)
            terms = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])
            code, at = np.r_[np.arange(many), many, many], np.r_[np.full(many, df), n_units, n_words]
            yield listed(terms, code, at, np.r_[np.bincount(once, minlength=many), np.count_nonzero(sizes), sizes.sum()].astype(np.int64))

    return _context_parts(utterances, dim, window).unionByName(said.mapInArrow(seen, LISTED))


def model_counts(utterances: DataFrame, units: DataFrame, dim: int = DIM, window: int = WINDOW) -> DataFrame:
    """All counts that context vectors and their weights depend on, as MODEL rows: integer sums over utterances and their units.

    Counts of parts of a corpus add up to those of the whole; what is taken back is added with the opposite sign.
    """
    return _rows(_merged(_model_parts(utterances, units, dim, window)))


def model_change(was: tuple[DataFrame, DataFrame], is_now: tuple[DataFrame, DataFrame], dim: int = DIM, window: int = WINDOW) -> DataFrame:
    """MODEL rows that turn the counts of utterances and units as they were into those as they are."""
    minus = _model_parts(*was, dim, window).withColumn("n", F.transform("n", lambda x: -x))
    return _rows(_merged(minus.unionByName(_model_parts(*is_now, dim, window))))


def added(counts: DataFrame) -> DataFrame:
    """MODEL rows summed up; what has been taken back altogether is gone."""
    return _rows(_lists(counts))


def words_of(counts: DataFrame) -> DataFrame:
    """(term, df, n_words, at, n) of MODEL rows, summed up. The row without a term has the number of units as df."""
    count = lambda place: F.get("n", (F.array_position("at", F.lit(place)) - 1).cast("int"))
    context = F.filter(F.arrays_zip("at", "n"), lambda e: e["at"] >= 0)
    found = _lists(counts).select("term", F.coalesce(count(DF), F.lit(0)).alias("df"), count(WORDS).alias("n_words"), context.alias("_e"))
    return found.select("term", "df", "n_words", F.col("_e.at").alias("at"), F.col("_e.n").alias("n"))
