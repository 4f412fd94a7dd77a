"""Reading landed transcript exports and separating records that cannot be used."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.schemas import CORRUPT, EXPORT, LOG, UTTERANCE

FORMATS = ("parquet", "json")


def export_reader(reader, format: str):
    """Set up a batch or streaming reader for one of the export formats."""
    if format == "parquet":
        return reader.format("parquet").schema(UTTERANCE)
    if format == "json":
        return (
            reader.format("json")
            .schema(EXPORT)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
        )
    raise ValueError(f"format must be one of {FORMATS}, got {format!r}")


def with_origin(exports: DataFrame) -> DataFrame:
    """Bring scanned exports into the log schema, with the file each record came from."""
    corrupt = F.col(CORRUPT) if CORRUPT in exports.columns else F.lit(None).cast("string").alias(CORRUPT)
    return exports.select(
        *[field.name for field in UTTERANCE.fields],
        corrupt,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
    )


def read_transcripts(spark: SparkSession, path: str, format: str = "parquet", origin: bool = True) -> DataFrame:
    """Scan a file or folder of exports into the log schema.

    The schema is fixed, so no pass is spent on inferring it, and on Parquet both
    column pruning and filters reach the scan. Without `origin` the file columns are
    left out; once asked for, Spark makes them for every row, used or not.
    """
    exports = export_reader(spark.read, format).load(path)
    return with_origin(exports) if origin else exports


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Exports that arrive as JSON text in a column, parsed as `read_transcripts` would.

    Other columns (say, source_file and file_mtime) are kept.
    """
    schema = T.StructType(EXPORT.fields)
    parsed = F.from_json(F.col(line), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in lines.columns if c != line]
    return lines.select(parsed.alias("_r"), *rest).select("_r.*", *rest)


def _faults(log: DataFrame) -> tuple[Column, Column]:
    """Whether a record is unparseable, and whether it was parsed but lacks its key. Parquet has no unparseable ones."""
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in log.columns else F.lit(False)
    return corrupt, ~corrupt & (F.col("conv_id").isNull() | F.col("turn").isNull())


def quarantine(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a stored log into usable records and the rest. Every record is in exactly one part."""
    corrupt, keyless = _faults(log)
    return log.filter(~(corrupt | keyless)).drop(CORRUPT), log.filter(corrupt | keyless)


def quarantine_counts(log: DataFrame) -> DataFrame:
    """One row: how many records are usable, unparseable, without a key, or without text."""
    corrupt, keyless = _faults(log)
    good = ~(corrupt | keyless)
    return log.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(good).alias("n_good"),
        F.count_if(corrupt).alias("n_corrupt"),
        F.count_if(keyless).alias("n_keyless"),
        F.count_if(good & F.col("text").isNull()).alias("n_no_text"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as `colloquy.streaming.ingest` stores it, with its bucket column."""
    schema = T.StructType([*LOG.fields, T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
