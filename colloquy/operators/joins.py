"""Joining the store with a side that is usually small, whatever its size turns out to be."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import BROADCAST_BYTES, BROADCAST_ROWS, Size, measure

SALTS = 64


def join_small(
    units: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    size: Size | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join `units` with `small`, whose size is given or measured here (it is then read twice).

    Below both bounds `small` is broadcast and `units` stay where they are. Beyond
    them both sides are shuffled with a salt next to the key, so that the rows of
    one hot key (a word in a third of the units) are spread over SALTS tasks;
    `small` is repeated once per salt.
    """
    if (size or measure(small)).within(max_rows, max_bytes):
        return units.join(F.broadcast(small), list(on), how)
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"{how} join cannot be salted")
    salted = units.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated.hint("shuffle_merge"), [*on, "_salt"], how).drop("_salt")
