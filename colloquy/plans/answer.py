"""From requests to the passages that answer them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.context import around_hits, assemble_context, spoken
from colloquy.operators.encode import corpus_stats, tfidf_requests, tfidf_rows
from colloquy.operators.joins import join_small
from colloquy.operators.dense import semantic_search
from colloquy.operators.meaning import DIM, context_entries, meaning_requests, meaning_vectors, word_vectors
from colloquy.operators.sparse import term_search
from colloquy.schemas import CHUNK_KEY, REQUEST_FILTERS, UTTERANCE_KEY
from colloquy.session import materialise


def lexical_hits(requests: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """TF-IDF hits of text requests over units, with statistics of those units."""
    stats = corpus_stats(units)
    return term_search(tfidf_requests(requests, stats), tfidf_rows(units, stats), k)


def meaning_hits(requests: DataFrame, utterances: DataFrame, units: DataFrame, k: int, dim: int = DIM) -> DataFrame:
    """Hits of text requests over units by meaning, with word vectors from the utterances the units are cut from."""
    stats = corpus_stats(units)
    vectors = word_vectors(context_entries(utterances, dim), dim, stats)
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    asked = meaning_requests(requests, stats, vectors, dim).select("req_id", *filters, "vec")
    return semantic_search(materialise(asked, "requests"), meaning_vectors(units, stats, vectors, dim), k)


def utterance_hits(hits: DataFrame) -> DataFrame:
    """One hit per request and utterance, ranked anew: chunks of one utterance count once."""
    best = hits.groupBy("req_id", *UTTERANCE_KEY).agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("req_id").orderBy("rank")
    return best.withColumn("rank", F.row_number().over(order))


def contexts(requests: DataFrame, utterances: DataFrame, units: DataFrame, k: int, max_chars: int) -> DataFrame:
    """Per request a text block of the utterances its best hits lie in, each with the turn before and after it."""
    hits = materialise(utterance_hits(lexical_hits(requests, units, k)), "hits")
    met = hits.select(*UTTERANCE_KEY).distinct()
    near = around_hits(met, utterances)
    lines = lambda side: F.transform(side, lambda u: spoken(u["role"], u["text"]))
    passage = F.array_join(F.concat(lines("before"), F.array(spoken(F.col("role"), F.col("text"))), lines("after")), "\n")
    passages = near.select(*UTTERANCE_KEY, F.lit(None).cast("string").alias("role"), passage.alias("text"))
    return assemble_context(hits, passages, max_chars, key=UTTERANCE_KEY)


def utterances_hit(hits: DataFrame, utterances: DataFrame) -> DataFrame:
    """The utterances hits lie in, so that only these are cut into chunks again. `hits` should be a written table."""
    return join_small(utterances, hits.select(*UTTERANCE_KEY).distinct(), UTTERANCE_KEY, spread_by=["text"], how="left_semi")


def with_text(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Hits with the speaker and the text of the unit. `hits` should be a written table."""
    texts = units.select(*CHUNK_KEY, "role", "text")
    return join_small(texts, hits, list(CHUNK_KEY), spread_by=list(CHUNK_KEY)).select(*hits.columns, "role", "text")
