"""What a poll of a growing file means, from snapshots of its identity and size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.running import LAST, SPAN, scan


def status(exists: Column, inode: Column, size: Column, known_inode: Column, total_read: Column) -> Column:
    """MOVED, DELETED, NEWDATA, UNCHANGED or TRUNCATED. A file first seen now counts as not moved."""
    return (
        F.when(~exists, "DELETED")
        .when(known_inode.isNotNull() & (known_inode != inode), "MOVED")
        .when(size > total_read, "NEWDATA")
        .when(size == total_read, "UNCHANGED")
        .otherwise("TRUNCATED")
    )


def classify(snapshots: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds `status` to (path, poll, exists, inode, size): each poll (a long) against the last state known of its path.

    The read position after a poll is the size seen; the first-known inode stays while a file is missing. One path's polls are scanned in ranges.
    """
    seen = lambda c: (LAST, F.when(F.col("exists"), F.col(c)))
    df = scan(snapshots, ["path"], "poll", {"known_inode": seen("inode"), "total_read": seen("size")}, span=span).withColumn("total_read", F.coalesce("total_read", F.lit(0)))
    return df.withColumn("status", status(F.col("exists"), F.col("inode"), F.col("size"), F.col("known_inode"), F.col("total_read")))


def stamped(polls: DataFrame, at: Column | None = None) -> DataFrame:
    """Polls with the time at which they were made, in milliseconds (`at`; else now)."""
    return polls.withColumn("ts_ms", F.unix_millis(F.current_timestamp() if at is None else at))


def polls_with_data(polls: DataFrame) -> DataFrame:
    return polls.where(F.col("nread") > 0)


def idle(polls: DataFrame, by: str) -> DataFrame:
    """Whether a round read nothing from any file (then the capture rests)."""
    return polls.groupBy(by).agg((~F.bool_or(F.col("nread") > 0)).alias("idle"), F.count("*").alias("polls"))
