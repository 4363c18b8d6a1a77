"""What the operators share: reading tables, Arrow passes over whole texts, durable tables."""

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows to an Arrow batch: whole texts go through, so a batch is kept to a few MB.
BATCH_ROWS = 512
#: Bitmaps of `told`, of 32,768 bits each: 4 MB in all, whatever the input.
MAPS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, are pruned at the scan."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def text_key(text: str | None) -> str:
    """The text's MD5; of a null text that of an empty one."""
    return md5((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """`rows` turns an iterator over the partition's rows (tuples) into one of result rows, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out = []
        for r in rows(source()):
            out.append(r)
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def text_udf(f: Callable[[list], Iterator], schema: str):
    """A column function of whole texts: `f` turns a batch's texts into results. Other columns of the row stay in the JVM, and rows meet their results without a join."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    kind = to_arrow_type(DataType.fromDDL(schema))

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(list(f(texts.to_pylist())), type=kind)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where spark.checkpoint.dir is unset (tests) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def durable(df: DataFrame) -> DataFrame:
    """Writes the table to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def told(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows with `_may`: whether the value of `column` may be one of the (only) column of wanted. True for all that are, and for some others.

    It needs no shuffle of the rows, only bitmaps of the wanted values' hashes, of bounded size; the more values, the more others are taken for
    them, so an exact join must follow.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAPS << 15))
    maps = wanted.select(place(wanted.columns[0]).alias("h")).groupBy(F.shiftright("h", 15).alias("_map")).agg(F.bitmap_construct_agg(F.col("h") % (1 << 15)).alias("_bits"))
    at = place(column) % (1 << 15)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.shiftright(place(column), 15) == F.col("_map"), "left")
    return met.select(*rows.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("_may"))


def likely(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows that `told` takes for wanted: before a join of wide rows of which few are, the others are left out without a shuffle."""
    return told(rows, column, wanted).where("_may").drop("_may")
