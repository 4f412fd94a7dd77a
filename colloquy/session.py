"""Session settings, the shared scratch folder, and size checks for broadcasts."""

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table is broadcast only after it was measured to be below both bounds.
BROADCAST_ROWS = 4_000_000
BROADCAST_BYTES = 128 * 1024 * 1024


def get_spark(app: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session's spark.checkpoint.dir names it.

    Only a local session may run without that setting: it gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="colloquy-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame, *key: str) -> DataFrame:
    """A scan of a few files, or of files that cannot be split, over all cores.

    Work per row is heavy in this package (a text becomes dozens of terms), so idle
    cores cost more than moving the rows. A scan that has a partition for every
    core, as any large table does, is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *key)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst a real size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def within(self, rows: int, size: int) -> bool:
        return self.rows <= rows and self.bytes <= size


def _width(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            total = F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x) + 16)
            return F.coalesce(total, F.lit(0).cast("long")) + 16
        return F.greatest(F.size(column), F.lit(0)).cast("long") * 8 + 16
    if isinstance(field.dataType, (T.StructType, T.MapType)):
        raise TypeError(f"cannot measure nested column {field.name}")
    return F.lit(8).cast("long")


def measure(df: DataFrame) -> Size:
    """Rows and approximate bytes of a table, counted by one aggregation."""
    widths = [_width(field) for field in df.schema.fields]
    total = sum(widths[1:], widths[0])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("b")).first()
    return Size(row["n"], row["b"] or 0)
