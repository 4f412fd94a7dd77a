"""Stored words: an inverted index of units as Parquet tables.

Under `path` lie
    postings    per word, blocks of about BLOCK units that have it: their keys, roles, counts of the word and lengths,
                and `impact`, the most that the word can add to a score in the block (before its idf)
    dictionary  per word: in how many units it is (df), in how many blocks these are dealt, its largest impact
    corpus      one row: units, words, and the parameters of BM25 that the impacts are for
Postings and dictionary are partitioned by a bucket of the word, so a search reads the buckets of its words only.

The number of blocks of a word is a power of two, and the block of a unit follows from its key's hash. So no list is
sorted or held together, however many units a word is in, and the block where a given unit would be is known.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import term_counts
from colloquy.operators.encode import CorpusStats, corpus_stats
from colloquy.schemas import CHUNK_KEY
from colloquy.session import BROADCAST_BYTES, BROADCAST_ROWS, measure

BUCKETS = 64
BLOCK = 512  # units of a block, about
LISTS = ("conv_id", "turn", "chunk", "role", "tf", "length")  # what a block holds of each of its units
SCHEMAS = {
    "postings": "term string, df long, blocks int, block int, impact double, conv_id_list array<long>, turn_list array<long>, chunk_list array<int>, "
    "role_list array<string>, tf_list array<long>, length_list array<long>, bucket int",
    "dictionary": "term string, df long, blocks int, impact double, bucket int",
}


@dataclass(frozen=True)
class Corpus:
    n_units: int
    n_words: int
    k1: float
    b: float
    buckets: int

    def share(self, tf: str = "tf", length: str = "length") -> Column:
        """What a word adds to a unit's score, before the word's weight."""
        mean = self.n_words / self.n_units if self.n_units else 1.0
        return F.col(tf) * (self.k1 + 1) / (F.col(tf) + self.k1 * (1 - self.b + self.b * F.col(length) / mean))

    def idf(self) -> Column:
        return F.log(1 + (F.lit(self.n_units) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bucket_of_term(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def block_of(blocks: Column) -> Column:
    """The block of the unit in a row, where a word has `blocks` of them (a power of two)."""
    return F.xxhash64(*CHUNK_KEY).bitwiseAND(blocks.cast("long") - 1).cast("int")


def _with_df(rows: DataFrame, stats: CorpusStats) -> DataFrame:
    """Rows of words with their df; no word that is in a large share of all units is a key of a shuffle."""
    if measure(stats.table).within(BROADCAST_ROWS, BROADCAST_BYTES):
        return rows.join(F.broadcast(stats.table), "term")
    hot = F.broadcast(stats.hot())
    cold = rows.join(hot.select("term"), "term", "left_anti").join(stats.table.hint("shuffle_merge"), "term")
    return rows.join(hot, "term").unionByName(cold)


def store_terms(units: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS, block: int = BLOCK) -> Corpus:
    """Index units (key, role, text). What lies at `path` is replaced."""
    spark, stats = units.sparkSession, corpus_stats(units)
    corpus = Corpus(stats.n_units, stats.n_words, k1, b, buckets)
    counted = units.select(*CHUNK_KEY, "role", term_counts(F.col("text")).alias("_t")).filter("_t IS NOT NULL")
    length = F.aggregate("_t", F.lit(0).cast("long"), lambda acc, t: acc + t["tf"]).alias("length")
    rows = _with_df(counted.select(*CHUNK_KEY, "role", length, F.inline("_t")), stats)
    needed = F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("df") / block)))
    rows = rows.withColumn("blocks", F.pow(F.lit(2.0), needed).cast("int"))
    rows = rows.withColumn("block", block_of(F.col("blocks"))).withColumn("_share", corpus.share())
    lists = [F.col(f"_u.{c}").alias(f"{c}_list") for c in LISTS]
    made = rows.groupBy("term", "df", "blocks", "block").agg(F.collect_list(F.struct(*LISTS)).alias("_u"), F.max("_share").alias("impact"))
    made = made.select(bucket_of_term(F.col("term"), buckets).alias("bucket"), "term", "df", "blocks", "block", "impact", *lists)
    # In order of words, so that what a file's footer says of them tells them apart.
    ordered = made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings")
    words = stored.groupBy("bucket", "term", "df", "blocks").agg(F.max("impact").alias("impact"))
    words.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/dictionary")
    meta = spark.createDataFrame([(corpus.n_units, corpus.n_words, k1, b, buckets)], "n_units long, n_words long, k1 double, b double, buckets int")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return corpus


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    return Corpus(**spark.read.parquet(f"{path}/corpus").first().asDict())


def read_terms(spark: SparkSession, path: str, table: str, terms: DataFrame, buckets: int) -> DataFrame:
    """Rows of `postings` or `dictionary` for the words in `terms`, from the buckets of these words alone."""
    wanted = terms.select("term").distinct()
    named = wanted.select(bucket_of_term(F.col("term"), buckets).alias("b")).distinct().collect()  # no more than there are buckets
    stored = spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}").filter(F.col("bucket").isin(sorted(row["b"] for row in named)))
    if measure(wanted).within(BROADCAST_ROWS, BROADCAST_BYTES):
        wanted = F.broadcast(wanted)
    return stored.join(wanted, "term", "left_semi")


def units_of(postings: DataFrame) -> DataFrame:
    """A row per word and unit."""
    zipped = F.arrays_zip(*[f"{c}_list" for c in LISTS])
    rest = [c for c in postings.columns if c not in [f"{c}_list" for c in LISTS]]
    return postings.select(*rest, F.explode(zipped).alias("_u")).select(*rest, *[F.col("_u")[f"{c}_list"].alias(c) for c in LISTS])
