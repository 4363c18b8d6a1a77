import pytest
from compare import views
from pyspark.sql import functions as F

from logweave.plans.views import conversations
from logweave.streaming.logstore import LogStore, slices_of
from logweave.streaming.reassemble import sequenced

SF = "/root/testdata/sf0.001"


def bodies_of(store):
    out = {}
    for r in store.chunks().orderBy("id", "offset").collect():
        assert r.offset == len(out.get(r.id, b""))  # ranges follow each other
        out[r.id] = out.get(r.id, b"") + bytes(r.payload)
    return out


def wanted():
    return {i: b.encode() for i, b in views(SF).sql("SELECT 'conv_' || conv_id, string_agg(text, '' ORDER BY turn) FROM conversations GROUP BY 1").fetchall()}


class Breaks(LogStore):
    """Stops between the output and its commit, or before any output."""

    when = "after"

    def append(self, decided, batch):
        if self.when == "before":
            raise RuntimeError("stopped")
        super().append(decided, batch)

    def commit(self, batch, data):
        if self.when == "after":
            raise RuntimeError("stopped")
        super().commit(batch, data)


@pytest.mark.parametrize("when", ["after", "before"])
def test_stop_between_output_and_commit(spark, tmp_path, when):
    rows = conversations(spark, SF)
    stream = lambda: sequenced(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    store, broken = LogStore(spark, f"{tmp_path}/store"), Breaks(spark, f"{tmp_path}/store")
    broken.when = when
    rows.where("seq <= 1").write.parquet(f"{tmp_path}/in")
    store.consume(stream(), f"{tmp_path}/state")
    before = {(r.batch, r.chunks, r.bytes) for r in store.ledger().collect()}
    rows.where("seq > 1").write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="stopped"):
        broken.consume(stream(), f"{tmp_path}/state")
    # Nothing of the failed batch is seen.
    assert {(r.batch, r.chunks, r.bytes) for r in store.ledger().collect()} == before
    assert {r.seq for r in store.chunks().select("seq").distinct().collect()} == {1}
    store.consume(stream(), f"{tmp_path}/state")
    assert bodies_of(store) == wanted()
    assert store.ledger().agg(F.sum("bytes")).first()[0] == sum(map(len, wanted().values()))
    assert {r.whole for r in store.extents().collect()} == {True}


def test_a_batch_that_counts_is_not_taken_again(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    assert store.ledger().isEmpty() and store.chunks().isEmpty()
    made = lambda body: spark.createDataFrame([("l", 1, 1, body, 0, "append"), ("l", 1, 1, b"old", None, "stale")], "id string, session bigint, seq bigint, payload binary, offset bigint, decision string")
    store.append(made(b"first"), 4)
    store.append(made(b"again"), 4)
    assert bodies_of(store) == {"l": b"first"}
    assert [tuple(r) for r in store.ledger().select("batch", "chunks", "bytes").collect()] == [(4, 1, 5)]
    store.append(made(b"x").where("false"), 5)  # an empty batch counts, too
    assert store.ledger().count() == 2


def test_slices_and_ranges_of_large_logs(spark, tmp_path):
    """Slices that cut chunks, hold many of them, and are larger than all; empty chunks."""
    pieces = [b"a" * 7, b"", b"bc" * 40, b"d", b"", b"e" * 300, b"f" * 64]
    rows, at = [], 0
    for i, p in enumerate(pieces, 1):
        rows.append(("l", 1, i, p, at, "append"))
        at += len(p)
    whole = b"".join(pieces)
    store = LogStore(spark, str(tmp_path))
    store.append(spark.createDataFrame(rows, "id string, session bigint, seq bigint, payload binary, offset bigint, decision string").repartition(3), 0)
    for size in (1, 10, 64, 100, 5000):
        got = {r.part: bytes(r.data) for r in slices_of(store.chunks(), size).collect()}
        assert got == {k: whole[k * size : (k + 1) * size] for k in range(-(-len(whole) // size))}
    for start, end in ((0, 5), (5, 9), (6, 380), (100, 101), (0, 10_000), (452, 452)):
        got = sorted((r.offset, bytes(r.data)) for r in store.byte_range("l", 1, start, end).collect())
        assert b"".join(d for _, d in got) == whole[start:end]
    assert store.byte_range("other", 1, 0, 9).isEmpty()
