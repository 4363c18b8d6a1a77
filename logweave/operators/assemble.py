"""Rebuilding logs from accepted chunks, and checking them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.naming import last_token, rebuilt_name
from logweave.operators.chunks import byte_offsets

LOG = ["id", "session"]


def bodies(chunks: DataFrame) -> DataFrame:
    """One row for each log with its bytes in order, cut by nothing. A body must fit in a row (2 GiB); see `export` for others."""
    whole = F.coalesce(F.expr("listagg(payload) WITHIN GROUP (ORDER BY seq)"), F.lit(b""))
    return chunks.groupBy(*LOG).agg(whole.alias("body"), F.max("seq").alias("last_seq"), F.count("*").alias("chunks")).withColumn("name", rebuilt_name(F.col("id"), F.col("session")))


def export(chunks: DataFrame, path: str) -> None:
    """Writes logs of any size: Parquet of (name, seq, offset, payload), ranged by log and place, sorted within.

    Reading the files of a name in order of `offset` gives its bytes. One log may span many files and tasks.
    """
    rows = byte_offsets(chunks).withColumn("name", rebuilt_name(F.col("id"), F.col("session")))
    rows.select("name", "seq", "offset", "payload").repartitionByRange("name", "offset").sortWithinPartitions("name", "offset").write.mode("overwrite").parquet(path)


def lines(logs: DataFrame, body: str = "body") -> DataFrame:
    """Splits whole bodies into lines; bytes that aren't UTF-8 become replacement characters."""
    text = F.try_validate_utf8(F.col(body).cast("string"))
    text = F.coalesce(text, F.make_valid_utf8(F.col(body).cast("string")))
    return logs.select(*LOG, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def check_counter(lined: DataFrame) -> DataFrame:
    """For each log: its lines, the last line's last token as a number, and the difference (0: nothing is missing)."""
    last = F.max_by(last_token(F.col("line")), "line_no").try_cast("bigint")
    out = lined.where(F.trim("line") != "").groupBy(*LOG).agg(F.count("*").alias("n_lines"), last.alias("counter"))
    return out.withColumn("delta", F.col("n_lines") - F.col("counter"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with counts (a multiset difference in one shuffle); empty: equal."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    out = both.groupBy(*a.columns).agg(F.sum("_n").alias("surplus")).where("surplus != 0")
    return out.withColumn("side", F.when(F.col("surplus") > 0, "source").otherwise("rebuilt")).withColumn("surplus", F.abs("surplus"))
