import os
from collections import Counter
from datetime import datetime, timedelta

import pytest

from logweave.sources.chunk_files import list_chunks
from logweave.sources.files import write_chunk_files
from logweave.streaming.delivery import Deliveries

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture
def setting(spark, tmp_path):
    folder, log = f"{tmp_path}/cache", f"{tmp_path}/sent"
    write_chunk_files(spark.range(6).selectExpr("'l' as id", "1L as session", "id as seq", "cast(concat('p', id) as binary) as payload"), folder)

    def uploader(path, body):
        name = os.path.basename(path)
        with open(log, "a") as f:
            f.write(f"{name}\n")
        return (503, "Throttle: 0") if name in ("l_1_4.pbData", "l_1_5.pbData") else (200, "Throttle: 0")

    def sent():
        return Counter(open(log).read().split()) if os.path.exists(log) else Counter()

    return folder, f"{tmp_path}/deliveries", uploader, sent


def test_restart_between_push_and_sweep_sends_nothing_twice(spark, setting):
    folder, path, uploader, sent = setting
    files = lambda: list_chunks(spark, folder)
    assert Deliveries(spark, path).send(files(), folder, uploader, at(0)) == 6
    again = Deliveries(spark, path)  # the first driver is lost before it deletes anything
    assert again.send(files(), folder, uploader, at(0.5)) == 0 and set(sent().values()) == {1}
    again.sweep(files())
    again.sweep(files())
    assert sorted(r.seq for r in files().collect()) == [4, 5]
    # Waits of 1, 2 and 4 seconds.
    for seconds, tried in ((1, 2), (2.9, 0), (3, 2), (6.9, 0), (7, 2)):
        assert again.send(files(), folder, uploader, at(seconds)) == tried, seconds
    assert sent() == {f"l_1_{i}.pbData": 4 if i > 3 else 1 for i in range(6)}
    assert {(r.attempts, r.action) for r in again.states().where("code = 503").collect()} == {(4, "retry")}


def test_a_round_without_its_ledger_row_does_not_count(spark, setting, monkeypatch):
    folder, path, uploader, sent = setting
    d = Deliveries(spark, path)
    d.due(list_chunks(spark, folder), at(0)).selectExpr("path", "mtime", "1 as attempts", "200 as code", "'delete' as action", "0 as throttle", "cast(null as timestamp) as next_try").write.parquet(f"{path}/tries/round=1")
    d.sweep(list_chunks(spark, folder))
    assert list_chunks(spark, folder).count() == 6 and d.states().isEmpty()
    assert d.send(list_chunks(spark, folder), folder, uploader, at(0)) == 6 and d.states().count() == 6


def test_new_file_under_an_old_name_and_compaction(spark, setting):
    folder, path, uploader, sent = setting
    files, d = lambda: list_chunks(spark, folder), Deliveries(spark, path)
    d.send(files(), folder, uploader, at(0))
    os.utime(f"{folder}/l_1_0.pbData", (1, 1))
    d.sweep(files())
    assert sorted(r.seq for r in files().collect()) == [0, 4, 5]  # what changed since is not deleted
    assert d.compact(files()) == 2 and d.compact(files()) == 2
    assert sorted(x for x in os.listdir(f"{path}/tries") if "=" in x) == ["round=3"]
    assert d.send(files(), folder, uploader, at(0.5)) == 1 and sent()["l_1_0.pbData"] == 2
    assert d.send(files(), folder, uploader, at(1)) == 2
    assert {r.attempts for r in d.states().where("code = 503").collect()} == {2}


def test_throttle_lengthens_the_wait(spark, setting):
    folder, path, _, _ = setting
    d = Deliveries(spark, path, most_wait=3)
    say = lambda path, body: (503, "Throttle: 5")
    tried = [d.send(list_chunks(spark, folder), folder, say, at(s)) for s in (0, 4.9, 5)]
    assert tried == [6, 0, 6]
