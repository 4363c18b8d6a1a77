"""Canonical schemas of the engine's DataFrames."""

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("session", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
TRACKER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("session", T.LongType()),
        T.StructField("last_seq", T.LongType()),
    ]
)
POLL = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("nread", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
    ]
)
CHUNK_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
KEYS = ("id", "session", "seq")
#: Largest chunk that a capture makes.
MAX_CHUNK = 65_536
