"""Which chunks may be appended: the next contiguous run of each session."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.naming import tracker_file_name
from logweave.operators.intervals import first_run, missing

LOG = ["id", "session"]


def decide(chunks: DataFrame, tracker: DataFrame | None = None, start: str = "first_seen", present: DataFrame | None = None) -> DataFrame:
    """Adds `last` (the tracker's value, else 0) and `decision` to de-duplicated chunks.

    append: continues the run; init: starts it (only where last = 0); stale: at or before `last`; gap: waits
    behind a missing chunk. start="first_seen" lets a session begin at its least seq, start="one" only at 1.
    With last = 0 a chunk 0 is taken and leaves `last` at 0. How far a session goes follows from the runs of its numbers
    (`intervals`), of which payloads know nothing: chunks meet one row a session. present: a table with the same (id, session, seq), repeats
    allowed, where that is cheaper to read than the chunks.
    """
    if start not in ("first_seen", "one"):
        raise ValueError(f"start: {start}")
    zero = F.lit(0).cast("bigint")
    known = tracker.select(*LOG, F.col("last_seq").alias("last")) if tracker is not None else None
    numbers = (chunks if present is None else present).select(*LOG, "seq")
    if known is not None:
        numbers = numbers.join(known, LOG, "left")
    # The first run past what is known: the session goes on in it or not at all.
    fresh = numbers.where(F.col("seq") > (zero if known is None else F.coalesce("last", zero)))
    ahead = first_run(fresh, LOG).select(*LOG, F.col("low").alias("_begin"), F.col("high").alias("upto"))
    about = ahead.withColumn("last", zero) if known is None else ahead.join(known, LOG, "full")
    placed = chunks.join(about, LOG, "left").withColumn("last", F.coalesce("last", zero))
    at, first = F.col("seq"), F.col("last") == 0
    runs = (F.col("_begin") == F.col("last") + 1) | (first if start == "first_seen" else F.lit(False))
    word = F.when(first & (at == 0), "init").when(at <= F.col("last"), "stale").when(runs & first & (at == F.col("_begin")), "init").when(runs & at.between(F.col("_begin"), F.col("upto")), "append").otherwise("gap")
    return placed.withColumn("decision", word).drop("_begin", "upto")


def accepted(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("decision").isin("append", "init"))


def gaps(chunks: DataFrame) -> DataFrame:
    """The missing ranges between present chunks, from the runs of their numbers."""
    out = missing(chunks, LOG)
    return out.select(*LOG, F.col("low").alias("first_missing"), F.col("high").alias("last_missing"), (F.col("high") - F.col("low") + 1).alias("missing"))


def next_tracker(decided: DataFrame) -> DataFrame:
    """The tracker after appending: one row for each session that has accepted chunks."""
    top = accepted(decided).groupBy(*LOG).agg(F.max("seq").alias("last_seq"))
    return top.withColumn("file_name", tracker_file_name(F.col("id"), F.col("session")))
