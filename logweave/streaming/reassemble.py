"""Continuous sequencing: keyed state holds the last appended number and the chunks that wait behind a gap.

State is (last, bytes so far) and a map of waiting chunks in RocksDB, so a session that waits for long costs disk, not memory; nor does a batch of a session need more
than a slice of memory, in or out. Waiting chunks are kept GROUP numbers to an entry, as each look at the state is a message to the JVM: a log of few chunks costs a few messages
a batch, whatever waits. Large payloads have entries of their own, so that an entry stays small. The output has one row a chunk: `append` rows in order within their session and batch, with their offset in the log, and `stale` rows
for redeliveries. With a patience, a gap that chunks have waited behind for so long gives one `expired` row: numbers seq to upto are missing. The state
can be read as tables and carried over into a new checkpoint, with another number of partitions.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logweave.functions.codec import decode_chunk
from logweave.functions.naming import CHUNK_SUFFIX, base_name, parse_chunk_name
from logweave.schema import CHUNK, CHUNK_FILE
from logweave.sources import folders
from logweave.sources.chunk_files import decoded

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = T.StructType([*CHUNK.fields, T.StructField("offset", T.LongType()), T.StructField("decision", T.StringType()), T.StructField("upto", T.LongType())])
#: Bytes of payloads of a session and batch that are held at a time.
SLICE = 64 << 20
#: Numbers to an entry of waiting chunks, and bytes from which on a payload has its own.
GROUP, LARGE = 16, 32 << 10
#: For batches of many small files: fewer than these are looked at by the driver, where Spark would start a task for each file, whose answers all go to the
#: driver; and a file counts as little more than its bytes when files are dealt to tasks (by default as 4 MB: 32 files a task).
MANY_FILES = {"spark.sql.sources.parallelPartitionDiscovery.threshold": "10000", "spark.sql.files.openCostInBytes": "65536"}
#: A state carried over: a row with `end` is (last appended, bytes so far), others are waiting chunks.
CARRIED = "id string, session bigint, seq bigint, end bigint, payload binary"


class _Rows:
    """Output rows of a key, up to a slice of them."""

    def __init__(self, key: tuple, size: int):
        self.key, self.size, self.rows, self.bytes = key, size, [], 0

    def add(self, seq: int, payload: bytes | None, offset: int | None, decision: str, upto: int | None = None) -> None:
        self.rows.append((seq, payload, offset, decision, upto))
        self.bytes += len(payload or b"")

    def full(self) -> bool:
        return self.bytes > self.size or len(self.rows) > 100_000

    def frame(self) -> pd.DataFrame:
        seqs, payloads, offsets, decisions, upto = zip(*self.rows, strict=True)
        self.rows, self.bytes = [], 0
        return pd.DataFrame({"id": self.key[0], "session": self.key[1], "seq": seqs, "payload": payloads, "offset": pd.array(offsets, "Int64"), "decision": decisions, "upto": pd.array(upto, "Int64")})


class _Nested(_Rows):
    """The same as a frame of one value: each column of a frame costs a fixed time to convert, which a log of few chunks would spend most of its time on."""

    def frame(self) -> pd.DataFrame:
        rows, self.rows, self.bytes = [(*self.key, *r) for r in self.rows], [], 0
        return pd.DataFrame({"rows": [rows]})


class Sequencer(StatefulProcessor):
    """Appends 1, 2, 3, ...; arrival order doesn't matter. start="first_seen" begins at the least number of the first batch.

    As in batches, a chunk 0 that comes before all others are appended is taken, once, and the session goes on as if at its start. patience_ms: how long
    chunks wait behind a gap until it is said to be expired, None: for ever. on_expiry="report" lets them go on waiting, "skip" gives the missing numbers up and
    appends what waits (they are stale should they still come). A patience needs timeMode ProcessingTime.
    """

    def __init__(self, start: str = "one", patience_ms: int | None = None, on_expiry: str = "report", slice_bytes: int = SLICE, rows: type[_Rows] = _Rows):
        if start not in ("one", "first_seen") or on_expiry not in ("report", "skip"):
            raise ValueError(f"start: {start}, on_expiry: {on_expiry}")
        self.start, self.patience_ms, self.on_expiry, self.slice_bytes, self.rows = start, patience_ms, on_expiry, slice_bytes, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("seq", T.LongType()), T.StructField("end", T.LongType())]))
        # An entry n >= 0 has numbers from GROUP * n on, rising, and their payloads; a null payload is in entry -number.
        key, value = T.StructType([T.StructField("entry", T.LongType())]), T.StructType([T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("payloads", T.ArrayType(T.BinaryType()))])
        self.waiting = handle.getMapState("waiting", key, value)
        # The timer that runs, 0 once it has, and the number that is waited for.
        self.deadline = handle.getValueState("deadline", T.StructType([T.StructField("at", T.LongType()), T.StructField("missing", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        was = self.last.get()
        known, (last, end) = was is not None, was or (0, 0)
        out, zero, least = self.rows(key, self.slice_bytes), None, None
        fresh: dict[int, bytes] = {}
        held = 0
        for pdf in rows:
            for seq, payload in zip(pdf["seq"], pdf["payload"], strict=True):
                seq, payload = int(seq), b"" if payload is None else bytes(payload)
                if not seq and not known and not last:
                    known, zero = True, payload
                elif not seq and zero is not None:
                    zero = payload  # a redelivery in the same batch: the last one counts
                elif seq <= last:
                    out.add(seq, payload, None, "stale")
                    if out.full():
                        yield out.frame()
                else:
                    held += len(payload) - len(fresh.get(seq, b""))
                    fresh[seq], least = payload, seq if least is None else min(seq, least)
                    if held > self.slice_bytes:  # the rest of this batch's chunks wait on disk until their turn
                        self._wait(fresh)
                        fresh, held = {}, 0
        if zero is not None:
            out.add(0, zero, end, "append")
            end += len(zero)
        if not last and least is not None and self.start == "first_seen":
            last = least - 1
        for last, payload in self._next(last, fresh):
            out.add(last, payload, end, "append")
            end += len(payload)
            if out.full():
                yield out.frame()
        self._wait(fresh, self.read)
        if (last or known) and (last, end) != was:
            self.last.update((last, end))
        self._watch(last, timerValues)
        if out.rows:
            yield out.frame()

    def _wait(self, fresh: dict[int, bytes], read: tuple[int | None, dict] = (None, {})) -> None:
        """Adds to those that wait; of a number that waits already the new payload counts. read: an entry and what it has, if that is known."""
        entries: dict[int, list[int]] = {}
        for seq in fresh:
            entries.setdefault(seq // GROUP, []).append(seq)
        for entry, seqs in entries.items():
            held = read[1] if entry == read[0] else self._held(entry)
            for seq in seqs:
                if len(fresh[seq]) >= LARGE:
                    self.waiting.updateValue((-seq,), ([seq], [fresh[seq]]))
                elif held.get(seq, b"") is None:
                    self.waiting.removeKey((-seq,))
                held[seq] = fresh[seq] if len(fresh[seq]) < LARGE else None
            self._keep(entry, held)

    def _held(self, entry: int) -> dict[int, bytes | None]:
        if not self.waiting.containsKey((entry,)):
            return {}
        seqs, payloads = self.waiting.getValue((entry,))
        return {int(seq): None if x is None else bytes(x) for seq, x in zip(seqs, payloads, strict=True)}

    def _keep(self, entry: int, held: dict[int, bytes | None]) -> None:
        if held:
            seqs = sorted(held)
            self.waiting.updateValue((entry,), (seqs, [held[seq] for seq in seqs]))
        else:
            self.waiting.removeKey((entry,))

    def _next(self, last: int, fresh: dict[int, bytes]):
        """(number, payload) of the chunks that follow, taken from the batch or from those that wait."""
        entry, held, full = None, {}, 0  # an entry is read when its first number is due, and written when the next one is
        while True:
            last += 1
            if last // GROUP != entry:
                if full > len(held):
                    self._keep(entry, held)
                entry = last // GROUP
                held = self._held(entry)
                full = len(held)
            if last not in fresh and last not in held:
                break
            waits = held.pop(last, b"")
            if waits is None:
                payload = fresh[last] if last in fresh else bytes(self.waiting.getValue((-last,))[1][0])
                self.waiting.removeKey((-last,))
            yield last, fresh.pop(last, waits if waits is not None else payload)
        if full > len(held):
            self._keep(entry, held)
        self.read = entry, held

    def _watch(self, last: int, timerValues) -> None:
        """A timer runs as long as chunks wait behind the same gap."""
        if self.patience_ms is None:
            return
        at, missing = self.deadline.get() or (0, None)
        waits = self.waiting.exists()
        if missing is not None and (not waits or missing != last + 1):
            if at:
                self.handle.deleteTimer(at)
            self.deadline.clear()
            missing = None
        if waits and missing is None:
            at = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(at)
            self.deadline.update((at, last + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, missing = self.deadline.get() or (0, None)
        if missing is None or at != expiredTimerInfo.getExpiryTimeInMs():
            return
        last, end = self.last.get() or (0, 0)
        out, first = self.rows(key, self.slice_bytes), min(self._held(min(int(k[0]) for k in self.waiting.keys() if k[0] >= 0)))
        out.add(missing, None, None, "expired", first - 1)
        self.deadline.update((0, missing))
        if self.on_expiry == "skip":
            last = first - 1
            for last, payload in self._next(last, {}):
                out.add(last, payload, end, "append")
                end += len(payload)
                if out.full():
                    yield out.frame()
            self.last.update((last, end))
            self._watch(last, timerValues)
        yield out.frame()

    def handleInitialState(self, key, initialState, timerValues):
        fresh, held = {}, 0
        for seq, end, payload in zip(initialState["seq"], initialState["end"], initialState["payload"], strict=True):
            if not pd.isna(end):
                self.last.update((int(seq), int(end)))
                continue
            held += len(payload)
            fresh[int(seq)] = bytes(payload)
            if held > self.slice_bytes:
                self._wait(fresh)
                fresh, held = {}, 0
        self._wait(fresh)
        self._watch(int((self.last.get() or (0, 0))[0]), timerValues)

    def close(self) -> None:
        pass


def chunk_file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, consumed: str = "off", archive: str | None = None, listing: str | None = None) -> DataFrame:
    """New chunk files as decoded chunks; malformed bodies and names are left out (batch reads report them).

    consumed: what becomes of files whose batch is committed: off, delete or archive (into the folder `archive`).
    listing: a folder of its own in which tasks note the files that are new, and from which the stream takes them. Without it the driver holds all of a folder's names, which is
    for folders that are emptied or stay small. With it files are looked for when the stream is defined, and by `folders.note` while it runs; those of one look come in no order.
    """
    if listing is not None:
        return _listed_stream(spark, path, files_per_batch, consumed, listing)
    stream = spark.readStream.format("binaryFile").schema(CHUNK_FILE).option("pathGlobFilter", "*.pbData")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    if consumed != "off":
        stream = stream.option("cleanSource", consumed)
    if archive:
        stream = stream.option("sourceArchiveDir", archive)
    return _well_formed(stream.load(path).select("path", decode_chunk("content").alias("b")))


def _well_formed(files: DataFrame) -> DataFrame:
    rows = files.select(parse_chunk_name(base_name(F.col("path"))).alias("k"), "b")
    return rows.where("k is not null and b.error is null").select("k.*", "b.payload")


def _listed_stream(spark: SparkSession, path: str, files_per_batch: int | None, consumed: str, listing: str) -> DataFrame:
    if consumed != "off" or not folders.is_folder(path):
        raise ValueError(f"a listing is of one folder whose files stay: {path}, {consumed}")
    folders.note(spark, path, listing, CHUNK_SUFFIX, files_per_batch)
    stream = spark.readStream.schema("path string")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", 1)  # one lot of them
    files = stream.parquet(listing).repartition(spark.sparkContext.defaultParallelism)
    return _well_formed(decoded(files, spark.conf.get("spark.sql.files.ignoreMissingFiles") == "true"))


def sequenced(chunks: DataFrame, start: str = "one", patience_ms: int | None = None, on_expiry: str = "report", initial: DataFrame | None = None) -> DataFrame:
    """Needs spark.sql.streaming.stateStore.providerClass = PROVIDER when the query starts. initial: a state `carried` over, for a new checkpoint's first batch."""
    held = initial.groupBy("id", "session") if initial is not None else None
    mode = "None" if patience_ms is None else "ProcessingTime"
    nested = T.StructType([T.StructField("rows", T.ArrayType(OUTPUT))])
    found = chunks.groupBy("id", "session").transformWithStateInPandas(Sequencer(start, patience_ms, on_expiry, rows=_Nested), outputStructType=nested, outputMode="Append", timeMode=mode, initialState=held)
    return found.select(F.inline("rows"))


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def tracker_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, session, last_seq, bytes) of each log, from the state of a sequenced stream as its last batch left it: a tracker for `decide`."""
    return _state(spark, checkpoint, "last").select("key.id", "key.session", F.col("value.seq").alias("last_seq"), F.col("value.end").alias("bytes"))


def waiting_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, session, seq, payload) of the chunks that wait behind a gap."""
    entries = _state(spark, checkpoint, "waiting").select("key.id", "key.session", F.arrays_zip("user_map_value.seqs", "user_map_value.payloads").alias("each"))
    return entries.select("id", "session", F.inline("each").alias("seq", "payload")).where("payload is not null")


def carried(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The whole state as CARRIED, for `sequenced(initial=...)`: a stream's number of state partitions is fixed by its checkpoint, and this leaves it behind."""
    tracked = tracker_of(spark, checkpoint).select("id", "session", F.col("last_seq").alias("seq"), F.col("bytes").alias("end"), F.lit(None).cast("binary").alias("payload"))
    return tracked.unionByName(waiting_of(spark, checkpoint).withColumn("end", F.lit(None).cast("bigint")))


def _available(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a stream with the settings above, which the session has until it stops. Batches without data are left out: a stream with timers has one after the other without end. So timers that are due run with the next batch that has data."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"} | MANY_FILES
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()  # file sources look at the session's settings in each batch
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def run_available(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Works off all that is there and stops; a later call goes on from the checkpoint, exactly once."""
    _available(spark, stream.writeStream.format("parquet").option("path", out), checkpoint)


def process_available(spark: SparkSession, stream: DataFrame, process, checkpoint: str) -> None:
    """The same with a sink of the caller's: process(batch, batch_id), whose normal return means that the batch is kept.

    A batch may come again after a failure, under the same batch_id.
    """
    _available(spark, stream.writeStream.foreachBatch(process), checkpoint)
