"""Cutting, numbering and de-duplicating chunks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators import segments
from logweave.operators.running import SPAN, running_total
from logweave.schema import KEYS, MAX_CHUNK


def split_fixed(df: DataFrame, payload: str = "payload", size: int = MAX_CHUNK) -> DataFrame:
    """Cuts `payload` (BINARY) into pieces of at most `size` bytes; adds `offset` and `piece`.

    An empty or null payload gives no row, as a read of nothing emits nothing.
    """
    n = F.octet_length(payload)
    cuts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    return df.withColumn("offset", F.explode(cuts)).withColumn("piece", F.substring(F.col(payload), F.col("offset") + 1, F.lit(size)))


def assign_sequence(df: DataFrame, keys: list[str], position: str, span: int = SPAN) -> DataFrame:
    """Adds `seq` = 1, 2, ... in the order of `position` (a long, unique within the key)."""
    return running_total(df, keys, position, F.lit(1), "_before", span).withColumn("seq", F.col("_before") + 1).drop("_before")


def dedup_last_write(df: DataFrame, *arrival: str | Column) -> DataFrame:
    """One row for each (id, session, seq): the one that arrived last. Dealt by all three keys, so no log is hot.

    `arrival` orders the rows of a key; with ties any of the tied rows may stay. With no order, redeliveries are
    taken to be identical.
    """
    if not arrival:
        return df.dropDuplicates(list(KEYS))
    last = F.max_by(F.struct("*"), F.struct(*arrival))
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in KEYS)).agg(last.alias("_row")).select("_row.*")


def duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.count("*").alias("copies")).where("copies > 1")


def byte_offsets(df: DataFrame) -> DataFrame:
    """Adds `offset` of each chunk in its rebuilt log, and `end`."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    return running_total(df, ["id", "session"], "seq", size, "offset").withColumn("end", F.col("offset") + size)


def merge_sets(a: DataFrame, b: DataFrame, value: str, *arrival: str | Column) -> DataFrame:
    """Merges two sets of chunks by key, as segments; where both have a key, b's value stays. arrival: orders the copies of a key within a set."""
    both = segments.merge(segments.segments_of(a, value, *arrival), segments.segments_of(b, value, *arrival))
    return segments.entries(both, value).withColumnRenamed("shared", "in_both")


def joined_values(df: DataFrame, value: str, *arrival: str | Column, between: str = "=", after: str = ",") -> DataFrame:
    """(id, session, chunks): a log's map from seq to value as text, in order of seq, put together from its segments; null values are left out."""
    held = segments.segments_of(df, value, *arrival)
    pair = F.transform(F.arrays_zip("at", "values"), lambda e: F.concat((F.col("part") * segments.SEGMENT + e["at"]).cast("string"), F.lit(between), e["values"]))
    texts = held.select("id", "session", "part", F.array_join(pair, after).alias("_text"))
    return texts.groupBy("id", "session").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "_text")))["_text"], after).alias("chunks"))


def session_ranks(df: DataFrame) -> DataFrame:
    """Chunk count and rank of each session of an id; ranks see one row a session."""
    each = df.groupBy("id", "session").agg(F.count("*").alias("chunks"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return each.withColumn("session_rank", F.dense_rank().over(Window.partitionBy("id").orderBy("session")).cast("bigint"))
