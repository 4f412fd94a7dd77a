"""Where a table must be cut to keep its first rows, found by counting: no task and no driver holds the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12  # a pass counts at most 2 ** BITS bins


def cut(rows: DataFrame, column: str, n: int) -> tuple[int, int] | None:
    """(value, before): the nth smallest number of the long `column` and how many rows have a smaller one.

    None where `rows` has no more than `n` rows, so that nothing is to be cut. The bin with the nth row is counted in finer
    bins until it is one number: six passes at most for 64 bits. `rows` is read in every pass: give a written table
    without nulls in `column`.
    """
    value = F.col(column)
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends["n"] <= n:
        return None
    if n <= 0:
        return ends["lo"], 0
    shift, before, within = 0, 0, F.lit(True)
    while (ends["hi"] >> shift) - (ends["lo"] >> shift) >= 1 << BITS:
        shift += 1
    while True:
        place = F.shiftright(value, shift)
        bins = rows.where(within).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(bins):
            if before + row["n"] >= n:
                break
            before += row["n"]
        if shift == 0:
            return row["bin"], before
        within, shift = place == row["bin"], max(0, shift - BITS)
