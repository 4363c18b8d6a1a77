"""Pushing queued files to a receiver: any uploader, and what is done with what was delivered.

The outcome table says of every file whether it may go (`delete`) or is tried again (`retry`), and how long the receiver wants us to wait.
"""

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.operators.pump import outcomes
from logweave.sources.folders import dealt, qualified, read, store

#: A receiver gets a path and its bytes, and answers with a code and a text.
Uploader = Callable[[str, bytes], tuple[int, str]]
# Fixed value of the protocol.
CONTENT_TYPE = "application/application/octet-stream"


def http_uploader(url: str, seconds: float = 30.0) -> Uploader:
    """Posts the bytes; an error of the connection is code 0, so that the file is tried again."""

    def send(path: str, body: bytes) -> tuple[int, str]:
        asked = urllib.request.Request(url, data=body, headers={"Content-Type": CONTENT_TYPE})
        try:
            with urllib.request.urlopen(asked, timeout=seconds) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")
        except OSError as e:
            return 0, str(e)

    return send


def push(spark: SparkSession, queue: DataFrame, folder: str, uploader: Uploader) -> DataFrame:
    """(path, code, body, action, throttle, and the queue's other columns) of each queued file that is still there; each task sends its files one after another.

    queue: (path, ...) of files in the folder, each once; only their bytes are read. At least once: a task that is run again sends its files again, and the receiver replaces by name.
    Write the result down before acting on it, so that no second look sends again.
    """
    at = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "/[^/]*$", "")
    rows = dealt(queue.where(at == qualified(folder))).dropDuplicates(["path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bodies in read(batches):
            said = [uploader(p, body) for p, body in zip(b.column("path").to_pylist(), bodies, strict=True)]
            answers = [pa.array([c for c, _ in said], pa.int32()), pa.array([t for _, t in said], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *answers], names=[*b.schema.names, "code", "body"])

    answered = T.StructType([*rows.schema.fields, T.StructField("code", T.IntegerType()), T.StructField("body", T.StringType())])
    return outcomes(rows.mapInArrow(run, answered))


def consume(delivered: DataFrame) -> None:
    """Deletes the files of an outcome table that may go, on the executors, in any store that `files.store` opens; one that has gone is done already."""

    def each(rows):
        for r in rows:
            at, path = store(r.path)
            try:
                at.delete_file(path)
            except FileNotFoundError:
                pass

    dealt(delivered.where("action = 'delete'").select("path")).foreachPartition(each)
