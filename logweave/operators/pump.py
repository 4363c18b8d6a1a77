"""Choosing what to push next, and what came of it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.throttle import parse_reply

# Fixed values of the push queue.
QUEUE = 16
WORKERS = 5


def candidates(listing: DataFrame, *busy: DataFrame, key: str = "path") -> DataFrame:
    """Files with readable attributes that no other table (waiting, running, uploading) holds."""
    out = listing.where(F.col("mtime").isNotNull())
    for x in busy:
        out = out.join(x.select(key), key, "left_anti")
    return out


def oldest_first(df: DataFrame) -> DataFrame:
    """By (mtime, path); rows without attributes come last."""
    return df.orderBy(F.col("mtime").asc_nulls_last(), "path")


def top_oldest(df: DataFrame, n: int = QUEUE) -> DataFrame:
    """The queue's content: each partition keeps n rows, the driver-side merge sees n per partition."""
    return oldest_first(df).limit(n)


def top_oldest_per_key(df: DataFrame, key: str, n: int = QUEUE) -> DataFrame:
    """Spark prunes to n rows a key before the shuffle (window group limit)."""
    order = Window.partitionBy(key).orderBy(F.col("mtime").asc_nulls_last(), "path")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def slots(queue: DataFrame, workers: int = WORKERS) -> DataFrame:
    """Hands a bounded queue to workers, oldest first. Takes the output of `top_oldest`, which is one partition."""
    return queue.withColumn("slot", F.ntile(workers).over(Window.orderBy(F.col("mtime").asc_nulls_last(), "path")))


def present(queue: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """What is still there: a queued file that has gone since counts as delivered and isn't pushed."""
    return queue.join(listing.select(key), key, "left_semi")


def in_flight(*busy: DataFrame, key: str = "path") -> DataFrame:
    """One row: how many different files are being worked on."""
    rows = busy[0].select(key)
    for x in busy[1:]:
        rows = rows.unionByName(x.select(key))
    return rows.agg(F.count_distinct(key).alias("in_flight"))


def outcome(code: Column) -> Column:
    """Only 200 counts as delivered; all else is kept for another try."""
    return F.when(code == 200, "delete").otherwise("retry")


def outcomes(replies: DataFrame) -> DataFrame:
    """The reply's throttle counts whatever the code."""
    return replies.withColumn("action", outcome(F.col("code"))).withColumn("throttle", parse_reply(F.col("body")))
