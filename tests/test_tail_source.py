import os

import pytest

from logweave.sources import tail_source
from logweave.sources.tail_source import TailReader, TailSource
from logweave.streaming.reassemble import run_available


def reader(path, **more):
    return TailReader({"paths": str(path), "session": "1", "chunksize": "4", "startingoffsets": "earliest", **more})


def batch(r, start):
    end = r.latestOffset()
    return end, [x for p in r.partitions(start, end) for x in r.read(p)]


def drained(r, start):
    out = []
    while True:
        end, rows = batch(r, start)
        if end == start:
            return end, out
        out, start = out + rows, end


def test_rotation_loses_no_byte(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"first")
    r = reader(path)
    at, rows = batch(r, r.initialOffset())
    with path.open("ab") as f:
        f.write(b" and a rest")
    os.rename(path, tmp_path / "a.log.1")
    path.write_bytes(b"new file")
    at, more = drained(r, at)
    rows += more
    assert b"".join(x[3] for x in rows) == b"first and a restnew file"
    assert [x[2] for x in rows] == list(range(1, len(rows) + 1))


def test_rotation_between_offset_and_read(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"old bytes")
    r = reader(path)
    start, end = r.initialOffset(), r.latestOffset()
    os.rename(path, tmp_path / "a.log.1")
    path.write_bytes(b"other text")
    parts = r.partitions(start, end)
    assert b"".join(x[3] for p in parts for x in r.read(p)) == b"old bytes"
    os.remove(tmp_path / "a.log.1")
    with pytest.raises(OSError):
        [x for p in parts for x in r.read(p)]


def test_truncated_and_late_files(tmp_path):
    path = tmp_path / "a.log"
    r = reader(path, startingoffsets="latest")
    at = r.latestOffset()
    path.write_bytes(b"late file")
    at, rows = drained(r, at)
    assert b"".join(x[3] for x in rows) == b"late file"
    with path.open("r+b") as f:
        f.truncate(0)
        f.write(b"short")
    end, more = batch(r, at)
    assert b"".join(x[3] for x in more) == b"short"
    parts = r.partitions(at, end)
    path.open("r+b").truncate(2)
    with pytest.raises(OSError):
        [x for p in parts for x in r.read(p)]


@pytest.mark.parametrize("before", [b"0123456789", b"head" * 2000, b"x" * 20_000])
@pytest.mark.parametrize("after", [b"another text that is longer than the position was " * 500, b"0123456789" * 3000])
def test_truncated_and_grown_past_the_position(tmp_path, before, after):
    path = tmp_path / "a.log"
    path.write_bytes(before)
    r = reader(path, chunksize="1000")
    at, rows = drained(r, r.initialOffset())
    with path.open("r+b") as f:
        f.truncate(0)
        f.write(after)
    at, more = drained(r, at)
    # Where the old bytes are the new ones' beginning, the file has only grown.
    grown = after.startswith(before)
    assert b"".join(x[3] for x in more) == (after[len(before) :] if grown else after)
    assert [x[2] for x in rows + more] == list(range(1, len(rows) + len(more) + 1))
    assert at[str(path)][4] == (0 if grown else 1)


def test_same_length_is_seen_when_it_grows(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"old line\n")
    r = reader(path)
    at, _ = drained(r, r.initialOffset())
    path.open("r+b").write(b"new line\n")
    at, rows = drained(r, at)
    assert rows == []  # nothing to read yet
    with path.open("ab") as f:
        f.write(b"more\n")
    assert b"".join(x[3] for x in drained(r, at)[1]) == b"new line\nmore\n"


def test_written_anew_twice_and_read_in_parts(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"a" * 10)
    r = reader(path, maxreads="2")
    at, rows = drained(r, r.initialOffset())
    for text in (b"b" * 30, b"c" * 40):
        path.write_bytes(text)
        at, more = drained(r, at)
        rows += more
    assert b"".join(x[3] for x in rows) == b"a" * 10 + b"b" * 30 + b"c" * 40
    assert [x[2] for x in rows] == list(range(1, len(rows) + 1)) and at[str(path)][4] == 2


def test_file_written_anew_between_runs_of_a_stream(spark, tmp_path):
    spark.dataSource.register(TailSource)
    path = tmp_path / "a.log"

    def run(data):
        path.open("r+b" if path.exists() else "wb").truncate(0)
        path.write_bytes(data)
        stream = spark.readStream.format("logtail").option("paths", str(path)).option("session", "1").option("startingOffsets", "earliest").load()
        run_available(spark, stream, f"{tmp_path}/out", f"{tmp_path}/state")
        return [bytes(x.payload) for x in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()]

    assert run(b"one\n") == [b"one\n"]
    assert run(b"a longer file\n") == [b"one\n", b"a longer file\n"]
    assert run(b"a longer file\nand its next line\n")[2:] == [b"and its next line\n"]


def test_many_rotated_files_take_few_tasks_and_looks(tmp_path, monkeypatch):
    names = [tmp_path / f"{i}.log" for i in range(600)]
    for p in names:
        p.write_text(f"old {p.name}")
    r, looks, scan = reader(",".join(map(str, names))), [], os.scandir
    monkeypatch.setattr(tail_source.os, "scandir", lambda folder: looks.append(folder) or scan(folder))
    at, rows = drained(r, r.initialOffset())
    for p in names:
        with p.open("a") as f:
            f.write(" and its end")
        os.rename(p, f"{p}.1")
        p.write_text(f"new {p.name}")
    end = r.latestOffset()
    parts = r.partitions(at, end)
    assert len(parts) == 3 and len(looks) == 1  # a look for all files, not one for each
    rows += [x for p in parts for x in r.read(p)]
    assert len(looks) == 4
    rows += drained(r, end)[1]
    for p in names:
        assert b"".join(x[3] for x in rows if x[0] == p.name).decode() == f"old {p.name} and its endnew {p.name}"


def test_a_name_that_became_another_files_is_looked_for_again(tmp_path):
    folders, path = tail_source.Folders(), tmp_path / "a.log"
    path.write_text("old")
    inode = path.stat().st_ino
    assert folders.find(str(tmp_path), inode) == str(path)
    os.rename(path, tmp_path / "a.log.1")
    path.write_text("new")
    assert folders.find(str(tmp_path), inode) == str(tmp_path / "a.log.1")
