"""Column expressions over text. All are evaluated inside one row: none needs a shuffle."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"  # a term: a run of Unicode letters and digits
TOKEN = r"\S+"  # a token: whatever stands between white space


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often `body` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased words in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def term_counts(text: Column) -> Column:
    """array<struct<term, tf>> of the words of one text.

    The words are sorted, so that each term is a run; its count is the distance
    to the start of the next run. Costs n log n whatever the length of the text.
    """

    def runs(s: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("long").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(words(text)), lambda s: F.when(F.size(s) > 0, runs(s)))


def windows_of_words(text: Column, width: int, overlap: int) -> Column:
    """Array of texts of at most `width` tokens, each sharing `overlap` with the one before."""
    step = width - overlap
    last = lambda w: F.ceil(F.greatest(F.size(w) - width, F.lit(0)) / F.lit(step)).cast("int")
    return let(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        lambda w: F.when(
            F.size(w) > 0,
            F.transform(
                F.sequence(F.lit(0), last(w)),
                lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(width)), " "),
            ),
        ),
    )


def sentence_list(text: Column) -> Column:
    """Sentences of a text: cut at line ends and after . ! ? followed by white space."""
    lines = F.regexp_replace(text, r"([.!?]+)\s+", "$1\n")
    pieces = F.transform(F.split(lines, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")

