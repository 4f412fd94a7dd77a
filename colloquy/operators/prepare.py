"""From the log to units of text: latest versions, chunks, sentences, term counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import sentence_list, term_counts, windows_of_words
from colloquy.schemas import UTTERANCE_KEY


def current(log: DataFrame) -> DataFrame:
    """The latest version of every utterance: by file time, then by file name, then by role and text.

    The last two decide between rows of one file that have the same key.

    The aggregation keeps one version per key before the shuffle, so an utterance
    that was exported over and over does not pile up in one task. The result is
    partitioned by (conv_id, turn), which chunk-level steps after it can reuse.
    """
    version = F.struct("file_mtime", "source_file", "role", "text")
    latest = F.max_by(F.struct("role", "text"), version)
    return log.groupBy(*UTTERANCE_KEY).agg(latest.alias("_v")).select(*UTTERANCE_KEY, "_v.role", "_v.text")


def by_utterance(units: DataFrame, parts: int | None = None) -> DataFrame:
    """Partition by (conv_id, turn), the finest key that keeps all parts of a text together.

    Sums per utterance or chunk need no further shuffle, and no meeting, however
    long, is one partition. The number is fixed, to spark.sql.shuffle.partitions if
    not given, because what follows multiplies the rows: adaptive execution would
    merge partitions by their size before that.
    """
    parts = parts or int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, *UTTERANCE_KEY)


def chunk(utterances: DataFrame, width: int = 40, overlap: int = 10) -> DataFrame:
    """Windows of `width` words that overlap by `overlap`; a text without words has none."""
    if not 0 <= overlap < width:
        raise ValueError("overlap must be at least 0 and less than width")
    pieces = F.posexplode(windows_of_words(F.col("text"), width, overlap)).alias("chunk", "text")
    return utterances.select(*UTTERANCE_KEY, "role", pieces).select(*UTTERANCE_KEY, "chunk", "role", "text")


def sentences(utterances: DataFrame) -> DataFrame:
    """One row per sentence with its position in the utterance."""
    pieces = F.posexplode(sentence_list(F.col("text"))).alias("sentence", "text")
    return utterances.select(*UTTERANCE_KEY, "role", pieces).select(*UTTERANCE_KEY, "sentence", "role", "text")


def terms(units: DataFrame) -> DataFrame:
    """One row per unit and distinct word, with its count. Counted within the row: no shuffle."""
    rest = [c for c in units.columns if c != "text"]
    return units.select(*rest, F.inline(term_counts(F.col("text"))))
