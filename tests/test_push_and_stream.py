import random
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.functions.naming import normal_path
from logweave.operators import pump
from logweave.operators.assemble import bodies
from logweave.operators.sequencing import accepted, decide
from logweave.plans.queries import QUERIES
from logweave.plans.views import conversations
from logweave.sources.files import write_chunk_files
from logweave.sources.push import consume, http_uploader, push
from logweave.streaming.reassemble import PROVIDER, Sequencer, carried, chunk_file_stream, process_available, run_available, sequenced, tracker_of, waiting_of

SF = "/root/testdata/sf0.001"
CHUNK = "id string, session bigint, seq bigint, payload binary"


class State:
    """Stands in for a state store."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None or bool(self.map)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def containsKey(self, k):
        return k in self.map

    def getValue(self, k):
        return self.map[k]

    def removeKey(self, k):
        del self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def keys(self):
        return iter(list(self.map))


class Clock:
    """Stands in for the handle's timers and the time."""

    def __init__(self):
        self.now, self.timers = 0, set()

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getExpiryTimeInMs(self):
        return self.due


def stubbed(*args, **options):
    s = Sequencer(*args, **options)
    s.last, s.waiting, s.deadline, s.handle = State(), State(), State(), Clock()
    return s


def given(s, *slices):
    """Output frames of a batch that comes in slices."""
    frames = iter([pd.DataFrame({"seq": seqs, "payload": [str(x).encode() for x in seqs]}) for seqs in slices])
    return list(s.handleInputRows(("log", 1), frames, s.handle))


def at(s, now):
    """Rows of the timers that are due."""
    s.handle.now, out = now, []
    for due in sorted(t for t in s.handle.timers if t <= now):
        s.handle.timers.remove(due)
        s.handle.due = due
        out += [tuple(r) for f in s.handleExpiredTimer(("log", 1), s.handle, s.handle) for r in f[["decision", "seq", "upto"]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False)]
    return out


def sequenced_by(start, *batches):
    s = stubbed(start)
    out = []
    for seqs in batches:
        for pdf in given(s, seqs):
            out += list(zip(pdf["seq"], pdf["decision"], strict=True))
    return out


@pytest.mark.parametrize("start", ["one", "first_seen"])
def test_batches_larger_than_a_slice(start):
    """The same rows and offsets whatever a slice holds, and no frame of more than a slice and a chunk."""
    rng = random.Random(5)
    batches = [[[rng.randrange(60) for _ in range(rng.randrange(1, 30))] for _ in range(3)] for _ in range(8)]
    whole, small = stubbed(start), stubbed(start, slice_bytes=7)
    for slices in batches:
        a, b = given(whole, *slices), given(small, *slices)
        assert all(sum(map(len, f["payload"])) <= 7 + 2 for f in b)
        rows = lambda frames: pd.concat(frames)[["seq", "payload", "offset", "decision"]].astype(str).values.tolist() if frames else []
        assert rows(a) == rows(b)
        assert (whole.last.value, whole.waiting.map) == (small.last.value, small.waiting.map)
    came = {seq for slices in batches for seqs in slices for seq in seqs}
    assert whole.last.value[0] + 1 not in came and set(range(whole.last.value[0] + 1)) - {0} <= came if start == "one" else whole.last.value[0] > 1


def test_gaps_expire():
    """A gap is reported once after the patience; a new one has a timer of its own; one that is filled has none left."""
    s = stubbed(patience_ms=100)
    given(s, [1, 4, 5, 8])
    s.handle.now = 50
    given(s, [9])
    assert at(s, 99) == [] and at(s, 100) == [("expired", 2, 3)] and at(s, 1000) == []
    given(s, [3])
    assert at(s, 2000) == [] and not s.handle.timers
    assert [f["seq"].tolist() for f in given(s, [2])] == [[2, 3, 4, 5]] and s.handle.timers == {2100}
    given(s, [6, 7])
    assert not s.handle.timers and at(s, 9000) == [] and not s.waiting.map


def test_gaps_are_skipped():
    s = stubbed(patience_ms=100, on_expiry="skip")
    given(s, [2, 5])
    assert at(s, 100) == [("expired", 1, 1), ("append", 2, None)] and s.handle.timers == {200}
    assert [f["decision"].tolist() for f in given(s, [1])] == [["stale"]]
    assert at(s, 200) == [("expired", 3, 4), ("append", 5, None)] and not s.handle.timers and s.last.value == (5, 2)
    with pytest.raises(ValueError):
        Sequencer(on_expiry="drop")


@pytest.mark.parametrize(
    ("start", "batches", "want"),
    [
        ("one", [[0, 1, 2]], "0a 1a 2a"),
        ("one", [[0], [1], [0]], "0a 1a 0s"),
        ("one", [[0], [0], [1]], "0a 0s 1a"),
        ("one", [[0, 0]], "0a"),
        ("one", [[3, 2], [0], [1]], "0a 1a 2a 3a"),
        ("one", [[1], [0]], "1a 0s"),
        ("one", [[0, 3, 4], [2], [1]], "0a 1a 2a 3a 4a"),
        ("first_seen", [[0, 3, 4]], "0a 3a 4a"),
        ("first_seen", [[4, 5], [3]], "4a 5a 3s"),
        ("first_seen", [[0], [7], [6]], "0a 7a 6s"),
    ],
)
def test_chunk_zero_and_starts(start, batches, want):
    assert " ".join(f"{seq}{word[0]}" for seq, word in sequenced_by(start, *batches)) == want


def test_stream_of_one_batch_equals_batch(spark):
    """Gapless, gapped, zero and first-seen sessions, as the batch operator decides them."""
    for start in ("one", "first_seen"):
        for seqs in ([1, 2, 3], [0, 1, 2], [0, 3, 4], [2, 3], [1, 2, 5, 6], [4], [0]):
            rows = [("log", 1, s, b"x") for s in seqs]
            batch = {r.seq for r in accepted(decide(spark.createDataFrame(rows, CHUNK), start=start)).collect()}
            assert {s for s, word in sequenced_by(start, seqs) if word == "append"} == batch, (start, seqs)


def test_files_are_streamed_and_consumed(spark, tmp_path):
    """Chunk files through the file stream, in two runs, with files that don't parse; delivered ones are deleted."""
    rows = conversations(spark, SF)
    folder, out, state = f"{tmp_path}/cache", f"{tmp_path}/out", f"{tmp_path}/state"
    write_chunk_files(rows.where("seq % 2 = 0"), folder)
    (tmp_path / "cache/junk.pbData").write_bytes(b"no chunk")
    stream = lambda: sequenced(chunk_file_stream(spark, folder, 1000, "delete"))
    run_available(spark, stream(), out, state)
    write_chunk_files(rows.where("seq % 2 = 1"), folder)
    run_available(spark, stream(), out, state)
    got = spark.read.parquet(out)
    assert got.count() == rows.count()
    want = {(r.id, bytes(r.body)) for r in bodies(rows).collect()}
    assert {(r.id, bytes(r.body)) for r in bodies(got.where("decision = 'append'")).collect()} == want


def test_sink_of_the_caller(spark, tmp_path):
    rows = conversations(spark, SF)
    rows.write.parquet(f"{tmp_path}/in")
    seen = Counter()
    process_available(spark, spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), lambda batch, nr: seen.update({nr: batch.count()}), f"{tmp_path}/state")
    assert sum(seen.values()) == rows.count()


@pytest.fixture
def receiver():
    got = {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            code = 503 if body.startswith(b"bad") else 200
            got[body] = got.get(body, 0) + 1
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"Throttle: 5" if code == 200 else b"later")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/data", got
    server.shutdown()


def test_push_keeps_what_was_not_delivered(spark, tmp_path, receiver):
    url, got = receiver
    for name, body in (("a", b"one"), ("b", b"two"), ("c", b"bad"), ("d", b"not queued")):
        (tmp_path / name).write_bytes(body)
    queue = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a", "b", "c", "gone")], "path string")
    found = push(spark, queue, str(tmp_path), http_uploader(url))
    found.write.parquet(f"{tmp_path}/.said")
    found = spark.read.parquet(f"{tmp_path}/.said")
    assert {(r.path[-1], r.code, r.action, r.throttle) for r in found.collect()} == {("a", 200, "delete", 5), ("b", 200, "delete", 5), ("c", 503, "retry", None)}
    assert set(got) == {b"one", b"two", b"bad"}
    consume(found)
    consume(found)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["c", "d"]
    # No receiver at all: everything is tried again.
    dead = push(spark, queue, str(tmp_path), http_uploader("http://127.0.0.1:9/data"))
    assert {(r.path[-1], r.action) for r in dead.collect()} == {("c", "retry")}


def test_orders(spark):
    """Rows come in the order that the queries promise."""
    rows = [tuple(r) for r in QUERIES["sort_chunks"](spark, SF).collect()]
    assert rows == sorted(rows) and len(rows) > 500
    rows = [(r.mtime is None, r.mtime, r.path) for r in QUERIES["sort_mtime"](spark, SF).collect()]
    key = lambda r: (r[0], r[1].timestamp() if r[1] else 0, r[2])
    assert rows == sorted(rows, key=key) and any(r[0] for r in rows)


def test_small_ones(spark):
    one = spark.createDataFrame([("p",), ("q",), ("p",)], "path string")
    assert pump.in_flight(one, one.limit(0)).first()[0] == 2
    paths = {"/a/b": "/a/b", "a//b/": "a/b", "/../a": "/a", "../a": "../a", "../../a/..": "../..", "": ".", "/": "/", "./.": ".", "a/..": ".", "/a/./../../b": "/b"}
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "p string").select("p", normal_path(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == paths | {None: None}
    empty = spark.createDataFrame([("l", 1, 2, None), ("l", 1, 1, b"a"), ("l", 1, 3, b"b"), ("m", 1, 1, None)], CHUNK)
    assert {(r.id, bytes(r.body)) for r in bodies(empty).collect()} == {("l", b"ab"), ("m", b"")}


def test_gaps_expire_in_a_running_stream(spark, tmp_path):
    """Chunks 1 and 3 come; the gap expires with nothing more coming, is given up, and chunk 2 is stale then."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = lambda *seqs: spark.createDataFrame([("l", 1, s, str(s).encode()) for s in seqs], CHUNK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows(1, 3)
    stream = sequenced(spark.readStream.schema(CHUNK).parquet(f"{tmp_path}/in"), patience_ms=1500, on_expiry="skip")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()

    def until(want):
        stop = time.monotonic() + 60
        while (got := [tuple(-1 if x is None else x for x in r) for r in seen_rows()]) != want:
            assert time.monotonic() < stop and query.isActive, (got, query.exception())
            time.sleep(0.3)

    def seen_rows():
        if not (tmp_path / "out/_spark_metadata/0").exists():
            return []
        return sorted(((r.decision, r.seq, r.upto, r.offset) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)

    try:
        until([("append", 1, -1, 0), ("append", 3, -1, 1), ("expired", 2, 2, -1)])
        rows(2)
        until([("append", 1, -1, 0), ("append", 3, -1, 1), ("expired", 2, 2, -1), ("stale", 2, -1, -1)])
    finally:
        query.stop()


def test_state_is_carried_over(spark, tmp_path):
    """A stream stopped with chunks waiting goes on in another checkpoint with another number of partitions: nothing is lost or appended twice."""
    rows = conversations(spark, SF)
    rows.where("seq = 1 or seq >= 4").write.parquet(f"{tmp_path}/a")
    run_available(spark, sequenced(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/a")), f"{tmp_path}/out1", f"{tmp_path}/s1")
    assert tracker_of(spark, f"{tmp_path}/s1").where("last_seq != 1").count() == 0
    assert waiting_of(spark, f"{tmp_path}/s1").count() == rows.where("seq >= 4").count()
    rows.where("seq <= 3").write.parquet(f"{tmp_path}/b")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        run_available(spark, sequenced(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/b"), initial=carried(spark, f"{tmp_path}/s1")), f"{tmp_path}/out2", f"{tmp_path}/s2")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    both = spark.read.parquet(f"{tmp_path}/out1").unionByName(spark.read.parquet(f"{tmp_path}/out2"))
    assert both.where("decision = 'append'").count() == rows.count()
    assert {(r.id, bytes(r.body)) for r in bodies(both.where("decision = 'append'")).collect()} == {(r.id, bytes(r.body)) for r in bodies(rows).collect()}
    assert {r.seq for r in both.where("decision = 'stale'").collect()} == {1}
    ends = {(r.id, r.last_seq, r.bytes) for r in tracker_of(spark, f"{tmp_path}/s2").collect()}
    assert ends == {(r.id, r.last_seq, len(r.body)) for r in bodies(rows).collect()}


class Counted(State):
    """Counts what would be messages to the JVM."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "containsKey", "getValue", "removeKey", "updateValue", "keys"):
            self.calls += 1
        return super().__getattribute__(name)


def test_few_messages_whatever_waits():
    """Of a log of 15 chunks that come even ones first; a message a chunk and state would be more than 40."""
    s = stubbed()
    s.last, s.waiting = Counted(), Counted()
    assert not given(s, range(2, 16, 2)) and s.last.calls + s.waiting.calls <= 4
    out = given(s, range(1, 16, 2))
    assert [x for f in out for x in f["seq"]] == list(range(1, 16)) and s.last.calls + s.waiting.calls <= 10


def test_large_payloads_wait_by_themselves(monkeypatch):
    """Over entries and lengths that change while chunks wait: entries stay small, and the last payload of a number counts."""
    from logweave.streaming import reassemble

    monkeypatch.setattr(reassemble, "LARGE", 3)
    rng, s, want, out = random.Random(3), stubbed(), {}, []
    for _ in range(60):
        seqs = [rng.randrange(2, 60) for _ in range(3)]
        bodies_ = [bytes(rng.randrange(6)) for _ in seqs]
        want |= dict(zip(seqs, bodies_, strict=True))
        out += s.handleInputRows(("log", 1), iter([pd.DataFrame({"seq": seqs, "payload": bodies_})]), s.handle)
        assert all(x is None or len(x) < 3 or k[0] < 0 for k, v in s.waiting.map.items() for x in v[1])
    missing = sorted(set(range(1, 60)) - set(want))
    want |= dict.fromkeys(missing, b"m")
    out += s.handleInputRows(("log", 1), iter([pd.DataFrame({"seq": missing, "payload": [b"m"] * len(missing)})]), s.handle)
    got = pd.concat(out)
    assert got["seq"].tolist() == list(range(1, 60)) and [bytes(x) for x in got["payload"]] == [want[k] for k in range(1, 60)]
    assert got["offset"].tolist() == [sum(len(want[i]) for i in range(1, k)) for k in range(1, 60)] and not s.waiting.map
