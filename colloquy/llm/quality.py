"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Every text gets counts of signs of poor text; each count is set against a unit, and the
largest of these ratios is its badness. Labelled documents are the holdout. Per stratum
and cutoff of a fixed grid, the good ones that the cutoff would reject are a binomial
count; the cutoff is admitted when, were its rate of false rejection as large as `risk`,
so low a count had a probability of at most `doubt` divided by the number of tests
(Bonferroni over all cutoffs and strata). Of the admitted cutoffs of a stratum the one
with the most poor documents less good ones rejected is taken; with none, the stratum has
no cutoff and only the base rules reject there.

Results in special cases: a null or empty text has no words and fails the base rules; a
null stratum is a stratum of its own; a document with several labels counts as good if all
of them are 1, labels that are null, or of no document, count nowhere, and repeated rows
of a labelled document count each. Empty tables of labels or documents give no cutoffs.
Other columns are kept, but
columns named as the results (ADDED) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import BROADCAST_BYTES, BROADCAST_ROWS, materialise, measure

ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "badness", "kept")
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Cutoffs of the badness, and what each ratio is measured in: at its unit a text is suspicious.
GRID = [round(2 ** (i / 4), 6) for i in range(-8, 17)]
UNITS = {"symbols": 0.3, "shouts": 0.3, "capitals": 0.4, "repeats": 0.2, "lines": 0.3, "sameness": 0.8}


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(column: Column, signs: str) -> Column:
    return F.translate(column, signs, "")


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    spaced = F.btrim(F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def _repeated(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more: sort (window, place), keep places beside an equal one."""

    def covered(places: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            return total + F.least(F.lit(WINDOW), F.get(places, i + 1) - F.get(places, i)).cast("long")

        indices = F.sequence(F.lit(0), F.size(places) - 1)
        return F.aggregate(indices, F.lit(0).cast("long"), add)

    def places(ordered: Column) -> Column:
        def repeated(i: Column) -> Column:
            own = F.get(ordered, i)
            same = (own["w"] == F.get(ordered, i - 1)["w"]) | (own["w"] == F.get(ordered, i + 1)["w"])
            return F.when(same, own["at"])

        found = F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), repeated)
        return let(F.sort_array(F.filter(found, lambda p: p.isNotNull())), covered)

    numbered = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("at")))
    several = let(F.sort_array(numbered), places)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(several)


def _repeat_words(words: Column) -> Column:
    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    counted = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), _repeated)
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(counted)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(_strip(line, WHITE)) > 0)
    return let(lines, lambda kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and badness."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n"),
            _repeat_words(words).alias("r"),
            F.size(F.array_distinct(words)).cast("long").alias("d"),
        )

    own = {f"_own{i}": c for i, c in enumerate(docs.columns) if c not in ADDED}  # numbered: no name of theirs can be one of ours
    counted = docs.select(
        *[F.col(f"`{c}`").alias(name) for name, c in own.items()],
        let(words_of(t), counts).alias("_w"),
        F.length(_strip(t, WHITE)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_strip(t, SYMBOLS))).cast("long").alias("n_symbols"),
        _dup_lines(t).alias("n_dup_lines"),
        (F.length(t) - F.length(_strip(t, "!"))).cast("long").alias("_shouts"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("_capitals"),
        (F.length(t) - F.length(_strip(t, "\n")) + 1).cast("long").alias("_lines"),
    )
    n = F.greatest(F.col("_w.n"), F.lit(1)).cast("double")
    ratios = {
        "symbols": F.col("n_symbols") / n,
        "shouts": F.col("_shouts") / n,
        "capitals": F.col("_capitals") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "repeats": F.col("_w.r") / n,
        "lines": F.col("n_dup_lines") / F.col("_lines").cast("double"),
        "sameness": F.when(F.col("_w.n") >= 50, 1 - F.col("_w.d") / n).otherwise(0.0),
    }
    failed = (F.col("_w.n") < 10) | (100 * F.col("_w.r") > 20 * F.col("_w.n"))
    return counted.select(
        *[F.col(name).alias(c) for name, c in own.items()],
        F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("_w.r").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.greatest(*[value / F.lit(UNITS[name]) for name, value in ratios.items()]).alias("badness"),
    )


def _ln_factorial(n: Column) -> Column:
    """ln n!, to about 1e-13: Stirling's series at n + 10, less the logarithms of the ten factors in between."""
    x = n.cast("double") + 10
    between = x * 0
    for i in range(10):
        between = between + F.ln(x - i)
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series - between


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate); 1 where k is not below the mean.

    Below the mean the terms fall from j = k downwards; 14 standard deviations of them
    are all that a double can show, so the work grows with the root of n.
    """
    odds = (1 - rate) / rate
    log_top = (
        _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
        + k * math.log(rate) + (n - k) * math.log1p(-rate)
    )
    most = F.least(k, F.ceil(14 * F.sqrt(n.cast("double") + 1)) + 50)

    def step(state: Column, i: Column) -> Column:
        j = (k - i).cast("double")
        term = state["term"] * (j + 1) / (n - j) * odds
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    down = F.when(most > 0, F.sequence(F.lit(1).cast("long"), most)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(down, start, step, lambda state: state["sum"])
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * total))


def learn(scored: DataFrame, labels: DataFrame, stratum: str, risk: float, doubt: float, key: str = "doc_id") -> DataFrame:
    """(stratum, cutoff, n_good, n_rejected, bound): one row per stratum with labelled documents that has an admitted cutoff.

    `scored` has `key`, `stratum`, badness and base_failed; base rules have done their work, so
    documents that fail them are no part of the holdout.
    """
    good = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_key")).agg((F.min("quality") == 1).cast("long").alias("_good"))
    )
    passed = sum(((F.col("badness") > cut).cast("int") for cut in GRID[1:]), (F.col("badness") > GRID[0]).cast("int"))
    held = scored.where(~F.col("base_failed")).select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{stratum}`").alias("stratum"), passed.alias("_passed")
    )
    cells = held.join(good, "_key").groupBy("stratum", "_passed").agg(
        F.sum("_good").alias("_g"), F.sum(1 - F.col("_good")).alias("_b")
    )
    # A few rows per stratum from here on: cell p holds what exceeds the first p cutoffs.
    whole = Window.partitionBy("stratum")
    wide = cells.groupBy("stratum").agg(
        F.sum("_g").alias("n_good"),
        *[F.sum(F.when(F.col("_passed") > i, F.col("_g")).otherwise(0)).alias(f"_g{i}") for i in range(len(GRID))],
        *[F.sum(F.when(F.col("_passed") > i, F.col("_b")).otherwise(0)).alias(f"_b{i}") for i in range(len(GRID))],
    )
    wide = materialise(wide, "holdout")
    tests = F.explode(F.array(*[
        F.struct(F.lit(cut).alias("cutoff"), F.col(f"_g{i}").alias("n_rejected"), F.col(f"_b{i}").alias("poor"))
        for i, cut in enumerate(GRID)
    ]))
    tested = wide.select("stratum", "n_good", tests.alias("t")).select("stratum", "n_good", "t.*")
    admitted = tested.withColumn("bound", binomial_tail(F.col("n_rejected"), F.col("n_good"), risk)).where(
        F.col("bound") <= doubt / (len(GRID) * max(1, wide.count()))
    )
    gain = F.struct((F.col("poor") - F.col("n_rejected")).alias("gain"), F.col("cutoff"))
    best = admitted.withColumn("_best", F.max(gain).over(whole)).where(gain == F.col("_best"))
    return materialise(best.select("stratum", "cutoff", "n_good", "n_rejected", "bound"), "thresholds")


def judge(scored: DataFrame, thresholds: DataFrame, stratum: str) -> DataFrame:
    """Adds kept: false if the base rules reject, or the badness exceeds its stratum's cutoff. A column `kept` is replaced."""
    cut = thresholds.select(F.col("stratum").alias("_stratum"), F.col("cutoff").alias("_cutoff"))
    if measure(cut).within(BROADCAST_ROWS, BROADCAST_BYTES):
        cut = F.broadcast(cut)
    own = {f"_own{i}": c for i, c in enumerate(scored.columns) if c != "kept"}
    rows = scored.select(
        *[F.col(f"`{c}`").alias(name) for name, c in own.items()],
        F.col(f"`{stratum}`").alias("_of"), F.col("badness").alias("_badness"), F.col("base_failed").alias("_failed"),
    )
    over = F.coalesce(F.col("_badness") > F.col("_cutoff"), F.lit(False))
    joined = rows.join(cut, F.col("_of").eqNullSafe(F.col("_stratum")), "left")
    return joined.select(*[F.col(name).alias(c) for name, c in own.items()], (~F.col("_failed") & ~over).alias("kept"))
