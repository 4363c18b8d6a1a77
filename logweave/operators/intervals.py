"""Sets of numbers as coalesced runs [low, high], one set a key: a table (keys, low, high) that merges with others.

Numbers are made into runs range by range (a range has at most SPAN numbers), and runs of ranges, or of several sets, are merged by a segmented scan of their
greatest end. So a session with any number of chunks is worked on by many tasks, and what is merged is as large as its gaps are many.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.running import MAX, SPAN, SUM, scan


def _ranked(df: DataFrame, keys: list[str], number: str, span: int) -> DataFrame:
    """(keys, _range, _n, _rank): narrow rows in one shuffle by key and range; equal numbers have equal ranks."""
    n = df.where(F.col(number).isNotNull()).select(*keys, F.col(number).cast("bigint").alias("_n")).withColumn("_range", F.floor(F.col("_n") / span)).repartition(*keys, "_range")
    return n.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys, "_range").orderBy("_n")))


def runs_of(df: DataFrame, keys: list[str], number: str = "seq", span: int = SPAN) -> DataFrame:
    """(keys, low, high) of the numbers (repeats allowed, nulls left out), coalesced. Only runs that reach an end of their range meet those of other ranges."""
    parts = _ranked(df, keys, number, span).groupBy(*keys, "_range", (F.col("_n") - F.col("_rank")).alias("_island")).agg(F.min("_n").alias("low"), F.max("_n").alias("high"))
    reaches = (F.col("low") == F.col("_range") * span) | (F.col("high") == F.col("_range") * span + span - 1)
    return parts.where(~reaches).select(*keys, "low", "high").unionByName(merged(parts.where(reaches).select(*keys, "low", "high"), keys, span))


def first_run(df: DataFrame, keys: list[str], number: str = "seq", span: int = SPAN) -> DataFrame:
    """(keys, low, high): the first of `runs_of`, in one aggregate a range and one over a key's ranges."""
    ranked = _ranked(df, keys, number, span).withColumn("_low", F.min("_n").over(Window.partitionBy(*keys, "_range")))
    each = ranked.groupBy(*keys, "_range").agg(F.min("_n").alias("low"), F.max(F.when(F.col("_n") - F.col("_rank") == F.col("_low") - 1, F.col("_n"))).alias("high"))
    parts = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("_parts"))  # a pair of numbers for each SPAN of them
    first = F.col("_parts")[0]
    high = F.aggregate("_parts", first["high"], lambda end, x: F.when((x["low"] == end + 1) & (x["low"] % span == 0), x["high"]).otherwise(end))
    return parts.select(*keys, first["low"].alias("low"), high.alias("high"))


def missing(df: DataFrame, keys: list[str], number: str = "seq", span: int = SPAN) -> DataFrame:
    """(keys, low, high) of the numbers between those that are there: within ranges, and between a key's ranges (a row for each of them)."""
    ranked = _ranked(df, keys, number, span)
    before = F.lag("_n").over(Window.partitionBy(*keys, "_range").orderBy("_n"))
    inside = ranked.withColumn("_before", before).where(F.col("_n") - F.col("_before") > 1).select(*keys, (F.col("_before") + 1).alias("low"), (F.col("_n") - 1).alias("high"))
    ends = ranked.groupBy(*keys, "_range").agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"))
    last = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range"))
    across = ends.withColumn("_before", last).where(F.col("_first") - F.col("_before") > 1).select(*keys, (F.col("_before") + 1).alias("low"), (F.col("_first") - 1).alias("high"))
    return inside.unionByName(across)


def merged(runs: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """The union of all runs of each key (they may touch, overlap or repeat), coalesced."""
    far = scan(runs, keys, "low", {"_far": (MAX, F.col("high"))}, ["high"], span)
    fresh = F.when(F.col("_far").isNull() | (F.col("low") > F.col("_far") + 1), 1).otherwise(0)
    nr = scan(far.withColumn("_fresh", fresh).drop("_far"), keys, "low", {"_nr": (SUM, F.col("_fresh").cast("bigint"))}, ["high"], span, inclusive=True)
    # Runs that tie in low and high are in one island whatever their order: only the first of them can be fresh.
    return nr.groupBy(*keys, "_nr").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_nr")


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return merged(a.select(*keys, "low", "high").unionByName(b.select(*keys, "low", "high")), keys)


def gaps_of(runs: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """(keys, low, high) of the numbers between coalesced runs."""
    before = scan(runs, keys, "low", {"_before": (MAX, F.col("high"))}, span=span)
    return before.where("_before is not null").select(*keys, (F.col("_before") + 1).alias("low"), (F.col("low") - 1).alias("high"))
