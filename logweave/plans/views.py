"""Chunk views over the test tables, in Spark and (as common table expressions) in plain SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.chunks import assign_sequence

SESSION = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations")
    return df.select(F.format_string("conv_%d", "conv_id").alias("id"), F.lit(SESSION).cast("bigint").alias("session"), (F.col("turn") + 1).alias("seq"), F.encode("text", "utf-8").alias("payload"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as chunks: numbers have gaps and repeats; `arrival` orders the repeats."""
    df = table(spark, sf_dir, "lineitem")
    text = F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag")
    return df.select(F.format_string("order_%d", "l_orderkey").alias("id"), F.lit(SESSION).cast("bigint").alias("session"), F.col("l_linenumber").cast("bigint").alias("seq"), F.encode(text, "utf-8").alias("payload"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("arrival"), "l_orderkey")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks of one log a type and one session a day, numbered by event_id; ts stands in for a file's mtime."""
    df = table(spark, sf_dir, "events")
    day = F.unix_seconds(F.date_trunc("day", "ts").cast("timestamp"))
    out = df.select(F.col("event_type").alias("id"), day.alias("session"), "event_id", F.col("ts").alias("mtime"), F.encode("props", "utf-8").alias("payload"), "value")
    return assign_sequence(out, ["id", "session"], "event_id")


CONV = f"conv AS (SELECT 'conv_' || conv_id AS id, {SESSION}::BIGINT AS session, turn + 1 AS seq, text AS payload FROM conversations)"
LINE = f"""line AS (SELECT 'order_' || l_orderkey AS id, {SESSION}::BIGINT AS session, l_linenumber::BIGINT AS seq, l_orderkey,
  concat_ws('|', l_partkey, l_suppkey, l_returnflag) AS payload, l_shipdate, l_partkey, l_suppkey FROM lineitem)"""
ONE = LINE + """, one AS (SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY id, session, seq ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1)"""
EVT = """evt AS (SELECT event_type AS id, epoch(date_trunc('day', ts))::BIGINT AS session, event_id, ts AS mtime, props AS payload, value,
  row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY event_id) AS seq FROM events)"""
