"""The registered queries: one or more per operator, each over whole tables.

Meetings are the table `conversations`; text requests are all rows of `benchmark`;
vector requests are the mean vectors of the labels in `embeddings`.
"""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import context, dense, encode, indexed, meaning, prepare, probed, pruned, ranking, sparse
from colloquy.plans import answer, meaning_store
from colloquy.plans.store import build_store, refresh_store
from colloquy.schemas import CHUNK_KEY, CORRUPT, UTTERANCE, UTTERANCE_KEY
from colloquy.session import materialise, scratch_path, spread
from colloquy.sources import compacted, term_index
from colloquy.sources.code_lists import store_codes
from colloquy.sources.transcripts import parse_lines, quarantine, quarantine_counts, read_log, read_transcripts
from colloquy.sources.vector_cells import store_cells
from colloquy.sources.vector_store import bucket_of, read_vectors, store_vectors
from colloquy.streaming import upkeep
from colloquy.streaming.ingest import ingest_stream

COLUMNS = [field.name for field in UTTERANCE.fields]
DIM = 256
K = 5
BUCKETS = 16
LETTERS = "abcdefghijklmnopqrstuvwxyz"


# --- inputs --------------------------------------------------------------------------


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_transcripts(spark, f"{sf_dir}/conversations.parquet", origin=False)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.chunk(spread(utterances(spark, sf_dir), *UTTERANCE_KEY))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("req_id"), "text")


def label_means(embeddings: DataFrame) -> DataFrame:
    """The mean vector of each label, added up per label and dimension."""
    parts = embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "x")))
    return means.groupBy(F.col("label").alias("req_id")).agg(F.transform(ordered, lambda s: s["x"]).alias("vec"))


def export_json(rows: DataFrame, path: str) -> None:
    """Write utterances as a transcription service would land them: files of JSON lines."""
    rows.select(F.to_json(F.struct(*COLUMNS)).alias("value")).write.mode("append").text(path)


def damaged_lines(rows: DataFrame) -> DataFrame:
    """JSON lines of which some are broken off, some have lost their key, and some their text."""
    line = F.to_json(
        F.struct(
            F.when(F.col("turn") != 7, F.col("conv_id")).alias("conv_id"),
            "turn",
            "role",
            F.when(F.col("turn") != 6, F.col("text")).alias("text"),
        )
    )
    half = F.substring(line, F.lit(1), (F.char_length(line) / 2).cast("int"))
    return rows.select(F.when(F.col("role") == "system", half).otherwise(line).alias("value"))


def versions(rows: DataFrame) -> DataFrame:
    """A log with corrected turns, stale ones that arrived late, ties of time broken by file name, and turns twice in one file."""

    def version(part: DataFrame, mark: str, day: str, file: str) -> DataFrame:
        return part.select(
            *UTTERANCE_KEY,
            "role",
            F.concat(F.lit(mark), F.col("text")).alias("text"),
            F.lit(file).alias("source_file"),
            F.lit(day).cast("timestamp").alias("file_mtime"),
        )

    return (
        version(rows, "", "2026-01-02", "export-b")
        .unionByName(version(rows.filter("role = 'assistant'"), "corrected: ", "2026-01-03", "export-a"))
        .unionByName(version(rows.filter("role = 'user'"), "stale: ", "2026-01-01", "export-z"))
        .unionByName(version(rows.filter("role = 'system'"), "tie: ", "2026-01-02", "export-c"))
        .unionByName(version(rows.filter("role = 'assistant'"), "again: ", "2026-01-03", "export-a"))
    )


# --- sources and sinks ---------------------------------------------------------------


def read_transcripts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = scratch_path(spark, "landed")
    export_json(utterances(spark, sf_dir), landed)
    good, _ = quarantine(read_transcripts(spark, landed, "json"))
    return good.select(*COLUMNS)


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed, log, checkpoint = (scratch_path(spark, name) for name in ("landed", "log", "offsets"))
    damaged_lines(utterances(spark, sf_dir)).write.text(landed)
    ingest_stream(spark, landed, log, checkpoint, buckets=BUCKETS)
    return quarantine_counts(read_log(spark, log))


def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged log record by record: which part each is in, and what was read of it."""
    landed = scratch_path(spark, "landed")
    damaged_lines(utterances(spark, sf_dir)).write.text(landed)
    good, bad = quarantine(read_transcripts(spark, landed, "json"))
    part = lambda rows, name, line: rows.select(F.lit(name).alias("part"), *COLUMNS, line.alias("line"))
    return part(good, "good", F.lit(None).cast("string")).unionByName(part(bad, "bad", F.col(CORRUPT)))


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports that arrive as lines in a column."""
    good, _ = quarantine(parse_lines(damaged_lines(utterances(spark, sf_dir))))
    return good.select(*COLUMNS)


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings land in two exports; the stream runs after each, and once more on nothing new."""
    landed, log, checkpoint = (scratch_path(spark, name) for name in ("landed", "log", "offsets"))
    rows = utterances(spark, sf_dir)
    export_json(rows.filter("role = 'user'"), landed)
    ingest_stream(spark, landed, log, checkpoint, buckets=BUCKETS)
    export_json(rows.filter("role <> 'user'"), landed)
    ingest_stream(spark, landed, log, checkpoint, buckets=BUCKETS)
    ingest_stream(spark, landed, log, checkpoint, buckets=BUCKETS)
    good, _ = quarantine(read_log(spark, log))
    return good.select(*COLUMNS)


def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.current(versions(utterances(spark, sf_dir)))


def _long(vectors: DataFrame) -> DataFrame:
    """Non-zero entries of dense vectors, one row each."""
    entries = vectors.select(*CHUNK_KEY, "encoder", F.round("norm", 6).alias("norm"), F.posexplode("vec").alias("bucket", "x"))
    return entries.filter("x <> 0").withColumn("value", F.col("x").cast("double")).drop("x")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all vectors, then replace the buckets of the meetings a system turn opens, and read all back."""
    path = scratch_path(spark, "vectors")
    vectors = encode.hash_vectors(chunks(spark, sf_dir), DIM)
    store_vectors(vectors, path, DIM, BUCKETS)
    stored = read_vectors(spark, path, f"hash-md5-{DIM}")
    touched = stored.filter("role = 'system'").select("bucket").distinct()
    again = materialise(stored.join(F.broadcast(touched), "bucket", "left_semi").drop("bucket"), "rewritten")
    store_vectors(again, path, DIM, BUCKETS)
    return _long(read_vectors(spark, path, f"hash-md5-{DIM}"))


def refreshed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build a store from a first export, then refresh it after corrections, withdrawals and late files.

    The second export has corrected system turns, and takes back all text of the meetings divisible by
    7. The third lands files that carry the first export's time, or one before it: meetings divisible by 5 plus 1000000.
    """
    landed, log, checkpoint, path = (scratch_path(spark, name) for name in ("landed", "log", "offsets", "vectors"))
    rows = utterances(spark, sf_dir)
    encoder = lambda units: encode.hash_vectors(units, DIM)
    export_json(rows, landed)
    ingest_stream(spark, landed, log, checkpoint, buckets=BUCKETS)
    first = materialise(read_log(spark, log), "first-log")
    build_store(first, encoder, path, DIM, BUCKETS)
    withdrawn = F.when(F.col("conv_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("corrected "), F.col("text")))
    export_json(rows.filter("role = 'system' OR conv_id % 7 = 0").withColumn("text", withdrawn), landed)
    ingest_stream(spark, landed, log, checkpoint, buckets=BUCKETS)
    refresh_store(spark, log, encoder, path, DIM, BUCKETS)
    late = first.filter("conv_id % 5 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000)
    stale = F.when(F.col("turn") % 2 == 0, F.col("file_mtime")).otherwise(F.col("file_mtime") - F.expr("INTERVAL 1 DAY"))
    late = late.withColumns({
        "file_mtime": stale, "source_file": F.concat(F.lit("late-"), (F.col("turn") % 2).cast("string")), "bucket": bucket_of(F.col("conv_id"), BUCKETS),
    })
    whole = scratch_path(spark, "whole-log")
    read_log(spark, log).unionByName(late).write.partitionBy("bucket").parquet(whole)
    refresh_store(spark, whole, encoder, path, DIM, BUCKETS)
    return _long(read_vectors(spark, path, f"hash-md5-{DIM}"))


# --- preparation ---------------------------------------------------------------------


def streamed_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports land twice, the second time with corrections, withdrawals and new meetings; the stream keeps the store up."""
    landed, log, checkpoint, path = (scratch_path(spark, name) for name in ("landed", "log", "offsets", "vectors"))
    rows = utterances(spark, sf_dir)
    for export in (rows, corrections(rows)):
        export_json(export, landed)
        upkeep.stream_to_store(spark, landed, log, checkpoint, lambda units: encode.hash_vectors(units, DIM), path, DIM, BUCKETS)
    return _long(read_vectors(spark, path, f"hash-md5-{DIM}"))


def compacted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log, compacted after the first landing: the view is the compacted table and the log's tail."""
    landed, log, checkpoint, path = (scratch_path(spark, name) for name in ("landed", "log", "offsets", "compacted"))
    rows = utterances(spark, sf_dir)
    export_json(rows, landed)
    upkeep.follow(spark, landed, log, checkpoint, buckets=BUCKETS)
    compacted.compact(spark, log, path, upkeep.marks(spark, log))
    export_json(corrections(rows), landed)
    upkeep.follow(spark, landed, log, checkpoint, buckets=BUCKETS)
    return compacted.current_rows(spark, log, path)


def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What user and assistant said in meetings with a system turn."""
    rows = utterances(spark, sf_dir)
    meetings = rows.filter("role = 'system'").select("conv_id")
    return ranking.restrict(rows, conv_ids=meetings, roles=["user", "assistant"]).select(*COLUMNS)


# --- encoders ------------------------------------------------------------------------


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = encode.tfidf(chunks(spark, sf_dir))
    return weighted.select(*CHUNK_KEY, "term", "tf", F.round("weight", 6).alias("weight"))


def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all words by the words beside them, as sums of integers."""
    return meaning.context_counts(spread(utterances(spark, sf_dir)))


def letter_model(letters: str):
    """A model of the user's own, for trying `encode`: how often each letter occurs in a text."""

    def load():
        def model(texts: list[str]) -> np.ndarray:
            return np.array([[text.lower().count(letter) for letter in letters] for text in texts], dtype=np.float32)

        return model

    return load


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(encode.encode(chunks(spark, sf_dir), letter_model(LETTERS), len(LETTERS), "letters"))


# --- retrieval -----------------------------------------------------------------------


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label the vectors closest to its mean."""
    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = materialise(label_means(stored), "requests")
    return dense.semantic_search(asked, stored.select("vec_id", F.col("embedding").alias("vec")), 10, key=["vec_id"])


def pruned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over vectors stored in cells, of which only those that may hold a hit are read."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    path, dim = scratch_path(spark, "cells"), len(vectors.filter("vec IS NOT NULL").first()["vec"])
    store_cells(vectors, path, dim, cells=64, key=["vec_id"])
    asked = materialise(label_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "requests")
    return pruned.pruned_search(spark, asked, path, 10, key=["vec_id"])


def hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = materialise(encode.hash_vectors(requests(spark, sf_dir), DIM).select("req_id", "vec"), "requests")
    return dense.semantic_search(asked, encode.hash_vectors(chunks(spark, sf_dir), DIM), K)


def restricted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that want 3 passages, said by the user."""
    asked = encode.hash_vectors(requests(spark, sf_dir), DIM).select("req_id", "vec")
    asked = asked.withColumns({"roles": F.array(F.lit("user")), "k": F.lit(3)})
    asked = materialise(asked, "requests")
    said = ranking.restrict_to(asked, spread(utterances(spark, sf_dir), *UTTERANCE_KEY))
    return dense.semantic_search(asked, encode.hash_vectors(prepare.chunk(said), DIM), K)


def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.lexical_hits(requests(spark, sf_dir), chunks(spark, sf_dir), K)


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = chunks(spark, sf_dir)
    return sparse.bm25_search(requests(spark, sf_dir), units, K, encode.corpus_stats(units))


def stored_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all passages are stored; requests read the postings of their words."""
    path = scratch_path(spark, "terms")
    term_index.store_terms(chunks(spark, sf_dir), path, buckets=BUCKETS)
    return indexed.stored_bm25_search(spark, requests(spark, sf_dir), path, K)


def lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with the request's own code in one of 40 tables of 6 bits."""
    asked = materialise(encode.hash_vectors(requests(spark, sf_dir), DIM).select("req_id", "vec"), "requests")
    return dense.lsh_search(asked, encode.hash_vectors(chunks(spark, sf_dir), DIM), K, DIM, tables=40, bits=6, flips=0)


def lsh_near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the operator's own settings, which find at least 0.9 of the true hits."""
    asked = materialise(encode.hash_vectors(requests(spark, sf_dir), DIM).select("req_id", "vec"), "requests")
    return dense.lsh_search(asked, encode.hash_vectors(chunks(spark, sf_dir), DIM), K, DIM)


def probed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors are stored in lists by code; requests look into the half of the lists that is nearest to them."""
    path = scratch_path(spark, "codes")
    store_codes(materialise(encode.hash_vectors(chunks(spark, sf_dir), DIM), "units"), path, DIM)
    asked = materialise(encode.hash_vectors(requests(spark, sf_dir), DIM).select("req_id", "vec"), "requests")
    return probed.probed_search(spark, asked, path, K)


def meaning_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each request the 3 passages closest in meaning, with speaker and text."""
    rows = utterances(spark, sf_dir)
    hits = answer.meaning_hits(requests(spark, sf_dir), spread(rows), chunks(spark, sf_dir), 3)
    hits = materialise(hits, "hits")
    return answer.with_text(hits, prepare.chunk(answer.utterances_hit(hits, rows)))


def _landed_log(spark: SparkSession, *exports: DataFrame) -> tuple[str, Callable[[DataFrame], None]]:
    """A log of exports that have landed, and a function that lets another one land."""
    landed, log, checkpoint = (scratch_path(spark, name) for name in ("landed", "log", "offsets"))

    def land(export: DataFrame) -> None:
        export_json(export, landed)
        ingest_stream(spark, landed, log, checkpoint, buckets=BUCKETS)

    for export in exports:
        land(export)
    return log, land


def stored_meaning_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages are stored by meaning once; requests are encoded with the stored model and meet stored vectors only."""
    log, _ = _landed_log(spark, utterances(spark, sf_dir))
    path = scratch_path(spark, "meaning-store")
    meaning_store.build_meaning_store(spark, log, path, buckets=BUCKETS)
    return meaning_store.stored_meaning_hits(spark, requests(spark, sf_dir), path, 3)


def corrections(rows: DataFrame) -> DataFrame:
    """Corrected system turns, meetings divisible by 7 whose text is taken back, and new meetings: those divisible by 5 plus 1000000."""
    withdrawn = F.when(F.col("conv_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("corrected "), F.col("text")))
    changed = rows.filter("role = 'system' OR conv_id % 7 = 0").withColumn("text", withdrawn)
    return changed.unionByName(rows.filter("conv_id % 5 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000))


def refreshed_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after corrections, withdrawals and new meetings: counts of what has changed are taken back and added."""
    rows = utterances(spark, sf_dir)
    log, land = _landed_log(spark, rows)
    path = scratch_path(spark, "meaning-store")
    meaning_store.build_meaning_store(spark, log, path, buckets=BUCKETS)
    land(corrections(rows))
    version = meaning_store.refresh_meaning(spark, log, path)
    return meaning_store.stored_meaning_hits(spark, requests(spark, sf_dir), path, 3, version)


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are stored; requests then name the meetings with a system turn, and only their buckets are read."""
    path = scratch_path(spark, "vectors")
    store_vectors(encode.hash_vectors(chunks(spark, sf_dir), DIM), path, DIM, BUCKETS)
    asked = materialise(encode.hash_vectors(requests(spark, sf_dir), DIM).select("req_id", "vec"), "requests")
    meetings = utterances(spark, sf_dir).filter("role = 'system'").select("conv_id").distinct()
    return dense.semantic_search(asked, read_vectors(spark, path, f"hash-md5-{DIM}", meetings, BUCKETS), K)


# --- context -------------------------------------------------------------------------


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = context.neighbours(utterances(spark, sf_dir))
    return near.select(
        *COLUMNS,
        F.get("before", 0)["turn"].alias("prev_turn"),
        F.get("before", 0)["text"].alias("prev_text"),
        F.get("after", 0)["turn"].alias("next_turn"),
        F.get("after", 0)["text"].alias("next_text"),
    )


def neighbours_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two utterances on either side, with meetings cut into spans of three turns."""
    near = context.neighbours(utterances(spark, sf_dir), r=2, span=3)
    turns = lambda side: F.array_join(F.transform(side, lambda u: u["turn"].cast("string")), ",")
    return near.select(*COLUMNS, turns("before").alias("before"), turns("after").alias("after"))


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = materialise(answer.lexical_hits(requests(spark, sf_dir), chunks(spark, sf_dir), K), "hits")
    units = prepare.chunk(answer.utterances_hit(hits, utterances(spark, sf_dir)))
    return context.assemble_context(hits, units, 600)


def merged_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one utterance that overlap are handed on as one span."""
    hits = materialise(answer.lexical_hits(requests(spark, sf_dir), chunks(spark, sf_dir), K), "hits")
    return context.merged_context(hits, utterances(spark, sf_dir), 600)


def around_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two utterances on either side of every hit, found by their places."""
    hits = answer.utterance_hits(answer.lexical_hits(requests(spark, sf_dir), chunks(spark, sf_dir), K))
    near = context.around_hits(materialise(hits, "hits"), utterances(spark, sf_dir), r=2, span=3)
    turns = lambda side: F.array_join(F.transform(side, lambda u: u["turn"].cast("string")), ",")
    return near.select("req_id", "rank", *UTTERANCE_KEY, turns("before").alias("before"), turns("after").alias("after"))


def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.contexts(requests(spark, sf_dir), utterances(spark, sf_dir), chunks(spark, sf_dir), K, 4000)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "read_transcripts": utterances,
        "read_transcripts_json": read_transcripts_json,
        "quarantine": quarantined,
        "quarantine_rows": quarantined_rows,
        "parse_lines": parsed_lines,
        "ingest_stream": ingested,
        "current_view": current_view,
        "store_vectors": stored_vectors,
        "refresh_store": refreshed_store,
        "stream_to_store": streamed_to_store,
        "compacted_view": compacted_view,
        "chunk": chunks,
        "sentences": lambda spark, sf_dir: prepare.sentences(utterances(spark, sf_dir)),
        "terms": lambda spark, sf_dir: prepare.terms(chunks(spark, sf_dir)),
        "restrict": restricted,
        "tfidf": tfidf,
        "hash_vectors": lambda spark, sf_dir: _long(encode.hash_vectors(chunks(spark, sf_dir), DIM)),
        "context_vectors": context_vectors,
        "encode": encoded,
        "semantic_search": semantic_search,
        "pruned_search": pruned_search,
        "hash_search": hash_search,
        "restricted_search": restricted_search,
        "term_search": term_search,
        "bm25_search": bm25_search,
        "stored_bm25_search": stored_bm25_search,
        "lsh_search": lsh_search,
        "lsh_near_search": lsh_near_search,
        "probed_search": probed_search,
        "meaning_search": meaning_search,
        "stored_search": stored_search,
        "stored_meaning_search": stored_meaning_search,
        "refresh_meaning": refreshed_meaning,
        "meeting_details": lambda spark, sf_dir: context.meeting_details(utterances(spark, sf_dir)),
        "neighbours": neighbours,
        "neighbours_spans": neighbours_spans,
        "assemble_context": assembled,
        "merged_context": merged_context,
        "around_hits": around_hits,
        "answer_contexts": answer_contexts,
    }
