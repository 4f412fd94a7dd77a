"""BM25 over stored words: exact, reading the postings of the requests' words and leaving out blocks that cannot matter.

1. A bound from below. The rarest words of a request give some units part of their score; the kth best of these is
   no more than the kth best score in the end.
2. Words that even together stay under that bound cannot bring a unit in (they are the words that most units have). Only
   the others' postings are added up, but for blocks that stay under the bound with everything else at its largest. Units
   whose sum stays under it with the former words at their largest are dropped. The kth best of these sums is a better bound,
   and units that stay under that one are dropped too.
3. For the units left, the block where each of the former words would have them is looked up, and what is there is added.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.text import term_counts
from colloquy.operators.ranking import admitted, largest_k, rank_hits
from colloquy.schemas import CHUNK_KEY, REQUEST_FILTERS
from colloquy.session import materialise
from colloquy.sources.term_index import Corpus, block_of, read_corpus, read_terms, units_of

SEEDS = 4096  # postings per request, about, that the bound from below is made of
SLACK = 1e-7  # scores nearer to a bound than this are decided later: sums differ by their order


def request_bounds(spark: SparkSession, requests: DataFrame, path: str, corpus: Corpus) -> DataFrame:
    """Words of the requests that the index has: weight, the most each can add, and sums of these in two orders; a written table."""
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    counted = materialise(requests.select("req_id", *filters, F.inline(term_counts(F.col("text")))), "request-terms")
    known = read_terms(spark, path, "dictionary", counted, corpus.buckets).select("term", "df", "blocks", F.col("impact").alias("_most"))
    asked = counted.join(known, "term").withColumn("weight", F.col("tf") * corpus.idf())
    asked = asked.withColumn("most", F.col("weight") * F.col("_most")).drop("tf", "_most")
    own = Window.partitionBy("req_id")
    small_first = own.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare_first = own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"upto": F.sum("most").over(small_first), "total": F.sum("most").over(own), "seen": F.sum("df").over(rare_first) - F.col("df")}
    return materialise(asked.withColumns(sums), "request-bounds")


def _parts(asked: DataFrame, postings: DataFrame, corpus: Corpus, filters: list[str]) -> DataFrame:
    """(req_id, key, part): what each word of a request adds to each unit that the request admits."""
    met = units_of(asked.join(postings, "term"))
    met = met.filter(admitted(filters)) if filters else met
    return met.select("req_id", *CHUNK_KEY, (F.col("weight") * corpus.share()).alias("part"))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("req_id", *CHUNK_KEY).agg(F.sum("part").alias("part"))


def stored_bm25_search(spark: SparkSession, requests: DataFrame, path: str, k: int) -> DataFrame:
    """Top-k of text requests by BM25 over the units that `store_terms` has put at `path`; hits as `bm25_search` gives them."""
    corpus = read_corpus(spark, path)
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    asked = request_bounds(spark, requests, path, corpus)
    postings = lambda words: read_terms(spark, path, "postings", words, corpus.buckets).drop("df", "blocks", "bucket")

    wanted = F.coalesce("k", F.lit(k)) if "k" in filters else F.lit(k)
    first = asked.filter(F.col("seen") < SEEDS)
    best = Window.partitionBy("req_id").orderBy(F.desc("part"))
    own = asked.groupBy("req_id").agg(*[F.first(c).alias(c) for c in filters]) if filters else asked.select("req_id").distinct()
    most = largest_k(requests, k)

    def kth(sums: DataFrame, name: str) -> DataFrame:
        """Per request the kth best of sums over some of its words, which the kth best score cannot be under."""
        ranked = sums.select("req_id", "part").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most)
        return ranked.join(own, "req_id").filter(F.col("_n") == wanted).select("req_id", (F.col("part") - SLACK).alias(name))

    seeds = _summed(_parts(first, postings(first), corpus, filters))
    asked = materialise(asked.join(kth(seeds, "bound"), "req_id", "left").fillna({"bound": 0.0}), "bounded")

    strong, weak = asked.filter("upto >= bound"), asked.filter("upto < bound")
    reached = postings(strong).join(strong.select("req_id", "term", "weight", "most", "total", "bound", *filters), "term")
    reached = reached.filter(F.col("weight") * F.col("impact") + F.col("total") - F.col("most") >= F.col("bound"))
    reached = units_of(reached)
    reached = reached.filter(admitted(filters)) if filters else reached
    sums = _summed(reached.select("req_id", *CHUNK_KEY, (F.col("weight") * corpus.share()).alias("part")))
    rest = asked.groupBy("req_id").agg(F.first("bound").alias("bound"), F.coalesce(F.max(F.when(F.col("upto") < F.col("bound"), F.col("upto"))), F.lit(0.0)).alias("rest"))
    left = materialise(sums.join(rest, "req_id").filter(F.col("part") + F.col("rest") >= F.col("bound")).drop("bound"), "candidates")
    left = left.join(materialise(kth(left, "_better"), "better-bounds"), "req_id", "left").fillna({"_better": 0.0})
    left = materialise(left.filter(F.col("part") + F.col("rest") >= F.col("_better")).drop("rest", "_better"), "better-candidates")

    sought = left.select("req_id", *CHUNK_KEY).join(weak.select("req_id", "term", "weight", "blocks"), "req_id")
    sought = sought.withColumn("block", block_of(F.col("blocks"))).drop("blocks")
    some = postings(weak).join(sought.select("term", "block").distinct(), ["term", "block"], "left_semi")
    found = units_of(some).join(sought, ["term", "block", *CHUNK_KEY])
    scored = _summed(left.unionByName(found.select("req_id", *CHUNK_KEY, (F.col("weight") * corpus.share()).alias("part"))))
    scored = scored.withColumnRenamed("part", "score")
    if "k" in filters:
        scored = scored.join(own.select("req_id", "k"), "req_id")
    return rank_hits(scored, CHUNK_KEY, k, most)
