"""Fixed schemas of the tables the package reads and writes."""

from pyspark.sql import types as T

UTTERANCE_KEY = ("conv_id", "turn")
CHUNK_KEY = ("conv_id", "turn", "chunk")

UTTERANCE = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

CORRUPT = "_corrupt_record"

# What a raw export is read into: an utterance, or the line that was not one.
EXPORT = T.StructType([*UTTERANCE.fields, T.StructField(CORRUPT, T.StringType())])

# The append-only log: every version of every utterance, and where it came from.
LOG = T.StructType(
    [
        *EXPORT.fields,
        T.StructField("source_file", T.StringType()),
        T.StructField("file_mtime", T.TimestampType()),
    ]
)

# Optional columns of a request; each is a condition on the units it may match.
REQUEST_FILTERS = ("conv_ids", "roles", "exclude_conv", "k")
