"""Column expressions over array<float> and array<double> vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def nonzero(vec: str) -> Column:
    return F.exists(vec, lambda x: x != 0)


def checked(vec: Column, dim: int) -> Column:
    """The vector itself; fails the job if it is missing, of another length, or has a NULL in it."""
    sound = vec.isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    message = F.concat(F.lit(f"vector of length {dim} expected, got length "), F.coalesce(F.size(vec), F.lit(-1)).cast("string"))
    return F.when(sound, vec).otherwise(F.raise_error(message))
