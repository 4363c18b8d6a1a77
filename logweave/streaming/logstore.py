"""A log store that only grows: each batch of a stream appends its own byte ranges, once.

The place of a chunk in its log comes from the sequencer's keyed state, so no batch looks at what was written before. `data/batch=N` holds a batch's chunks with
their offsets, `ledger/batch=N` one row that says that they count. A batch that comes again after a failure is left alone if the ledger has it, and
written anew if not: what a failed attempt left is overwritten, and never read, for readers start from the ledger.
Paths are any that Spark writes to. A log may be larger than a row: it is read by chunks, byte ranges or slices of a size.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.assemble import LOG
from logweave.schema import MAX_CHUNK
from logweave.streaming.reassemble import process_available

LEDGER = "batch bigint, chunks bigint, bytes bigint"
DATA = "id string, session bigint, seq bigint, offset bigint, size bigint, payload binary, batch bigint"


class LogStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self, path: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """(batch, chunks, bytes) of the batches that count."""
        return self._read("ledger", LEDGER)

    def chunks(self) -> DataFrame:
        """(id, session, seq, offset, size, payload, batch) of all batches that count."""
        return self._read("data", DATA).join(self.ledger().select("batch"), "batch", "left_semi")

    def append(self, decided: DataFrame, batch: int) -> None:
        """Takes the `append` rows of a sequencer's output (with offset); batch: the stream's number of it. Does nothing if the ledger has the batch."""
        if not self.ledger().where(F.col("batch") == batch).isEmpty():
            return
        rows = decided.where("decision = 'append'").select("id", "session", "seq", "offset", F.octet_length("payload").cast("bigint").alias("size"), "payload")
        data = f"{self.path}/data/batch={batch}"
        rows.write.mode("overwrite").parquet(data)
        self.commit(batch, data)

    def commit(self, batch: int, data: str) -> None:
        """One row, of what is really there, put in place by one rename."""
        wrote = self.spark.read.schema("size bigint").parquet(data).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        wrote.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def extents(self) -> DataFrame:
        """(id, session, chunks, bytes, whole) of each log; whole: its byte ranges fill it from 0 to its end, each once."""
        end = F.max(F.col("offset") + F.col("size"))
        sums = self.chunks().groupBy(*LOG).agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), (F.min("offset") == 0).alias("_from"), end.alias("_end"))
        return sums.withColumn("whole", F.col("_from") & (F.col("_end") == F.col("bytes"))).drop("_from", "_end")

    def slices(self, size: int = MAX_CHUNK) -> DataFrame:
        """(id, session, part, data): the logs cut into rows of `size` bytes (the last one shorter), whatever the chunks are. Dealt by log and part."""
        return slices_of(self.chunks(), size)

    def byte_range(self, id: str, session: int, start: int, end: int) -> DataFrame:
        """(offset, data) of the pieces of [start, end), to be put together by offset. The bounds reach the scan."""
        stop = F.col("offset") + F.col("size")
        rows = self.chunks().where((F.col("id") == id) & (F.col("session") == session) & (F.col("offset") < end) & (stop > start))
        low = F.greatest(F.col("offset"), F.lit(start))
        return rows.select(low.alias("offset"), F.substring("payload", (low - F.col("offset") + 1).cast("int"), (F.least(stop, F.lit(end)) - low).cast("int")).alias("data"))

    def consume(self, stream: DataFrame, checkpoint: str) -> None:
        """Works off all that a sequenced stream has and stops; a later call goes on from the checkpoint."""
        process_available(self.spark, stream, self.append, checkpoint)


def slices_of(chunks: DataFrame, size: int) -> DataFrame:
    """chunks: (id, session, offset, size, payload)."""
    stop = F.col("offset") + F.col("size")
    parts = F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((stop - 1) / size)))
    low, high = F.greatest("offset", F.col("part") * size), F.least("stop", (F.col("part") + 1) * size)
    cut = chunks.where("size > 0").withColumn("stop", stop).withColumn("part", parts)
    cut = cut.select(*LOG, "part", low.alias("_at"), F.substring("payload", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("_piece"))
    return cut.groupBy(*LOG, "part").agg(F.expr("listagg(_piece) within group (order by _at)").alias("data"))
