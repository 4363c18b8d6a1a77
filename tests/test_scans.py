"""Scans and interval sets against plain loops, with ranges so small that every key spans many."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions import throttle
from logweave.operators import intervals, running, sequencing, tail

OPS = {"SUM": lambda xs: sum(x for x in xs if x is not None), "MAX": lambda xs: max((x for x in xs if x is not None), default=None), "MIN": lambda xs: min((x for x in xs if x is not None), default=None), "LAST": lambda xs: next((x for x in reversed(xs) if x is not None), None)}
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-40, 40), st.one_of(st.none(), st.integers(-5, 5))), max_size=40, unique_by=lambda r: (r[0], r[1]))


@few
@given(rows, st.booleans())
def test_scans_equal_loops(spark, data, inclusive):
    df = spark.createDataFrame(data, "k string, at bigint, v bigint").repartition(3)
    got = running.scan(df, ["k"], "at", {n: (getattr(running, n), F.col("v")) for n in OPS}, span=7, inclusive=inclusive).collect()
    assert len(got) == len(data)
    for r in got:
        before = [v for at, v in sorted(((at, v) for k, at, v in data if k == r.k and (at < r["at"] or (inclusive and at == r["at"]))), key=lambda x: x[0])]
        for n, f in OPS.items():
            assert r[n] == f(before), (n, r, data)


numbers = st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 40)), max_size=50)


def plain_runs(data):
    out = []
    for k in "ab":
        for n in sorted({n for x, n in data if x == k}):
            if out and out[-1][0] == k and out[-1][2] == n - 1:
                out[-1][2] = n
            else:
                out.append([k, n, n])
    return sorted(map(tuple, out))


@few
@given(numbers, numbers)
def test_interval_sets(spark, one, two):
    made = lambda d: intervals.runs_of(spark.createDataFrame(d, "k string, seq bigint"), ["k"], span=4)
    got = lambda df: sorted(tuple(r) for r in df.select("k", "low", "high").collect())
    a, b = made(one), made(two)
    assert got(a) == plain_runs(one)
    assert got(intervals.union(a, b, ["k"])) == plain_runs(one + two)
    runs = plain_runs(one)
    between = sorted((x, h + 1, lo - 1) for (x, _, h), (y, lo, _) in zip(runs, runs[1:], strict=False) if x == y)
    df = spark.createDataFrame(one, "k string, seq bigint")
    assert got(intervals.gaps_of(a, ["k"], span=4)) == between == got(intervals.missing(df, ["k"], span=4))
    assert got(intervals.first_run(df, ["k"], span=4)) == sorted(next(r for r in runs if r[0] == k) for k in {r[0] for r in runs})


def test_wide_runs_meet_over_ranges(spark):
    """A run that covers later ones, over many ranges, and ties."""
    runs = spark.createDataFrame([("a", 0, 100), ("a", 3, 5), ("a", 50, 60), ("a", 50, 60), ("a", 101, 102), ("a", 104, 104), ("b", 7, 7)], "k string, low bigint, high bigint")
    assert sorted(tuple(r) for r in intervals.merged(runs, ["k"], span=10).collect()) == [("a", 0, 102), ("a", 104, 104), ("b", 7, 7)]


@pytest.mark.parametrize("start", ["one", "first_seen"])
def test_decisions_equal_a_loop(spark, start):
    sessions = {f"s{i}": (seqs, last) for i, (seqs, last) in enumerate([([1, 2, 3], 0), ([0, 1, 2], 0), ([0], 0), ([2, 3, 5], 0), ([3, 4], 2), ([1, 2, 4], 2), ([-1, 0, 1], 0), ([5], 2), ([1], 3), ([-3, 2], 0), (list(range(1, 30)), 7)])}
    want = set()
    for id, (seqs, last) in sessions.items():
        fresh = [s for s in seqs if s > last]
        end = (min(fresh, default=1) - 1) if start == "first_seen" and not last else last
        base = end
        while end + 1 in fresh:
            end += 1
        for s in seqs:
            first = not last and (s == 0 or (s == base + 1 and s <= end))
            want.add((id, s, last, "init" if first else "stale" if s <= last else "append" if s <= end else "gap"))
    chunks = spark.createDataFrame([(i, 1, s, b"x") for i, (seqs, _) in sessions.items() for s in seqs], "id string, session bigint, seq bigint, payload binary")
    tracker = spark.createDataFrame([(i, 1, last) for i, (_, last) in sessions.items() if last], "id string, session bigint, last_seq bigint")
    got = {(r.id, r.seq, r["last"], r.decision) for r in sequencing.decide(chunks, tracker, start).collect()}
    assert got == want


def test_hot_session_is_dealt_to_many_tasks(spark):
    """No step of the plan deals a session's rows by the session alone before they are runs."""
    n = 6 * running.SPAN
    chunks = spark.range(n).select(F.lit("hot").alias("id"), F.lit(1).cast("bigint").alias("session"), F.col("id").alias("seq")).where("seq % 100000 <> 5")
    assert [(r.first_missing, r.missing) for r in sequencing.gaps(chunks).orderBy("first_missing").collect()] == [(k * 100_000 + 5, 1) for k in range(4)]


def test_polls_and_throttle_in_ranges(spark):
    polls = [("p", i, i % 5 > 0, str(i // 9) if i % 5 else None, i % 4 if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(polls, "path string, poll bigint, exists boolean, inode string, size bigint")
    got = {r.poll: (r.known_inode, r.total_read) for r in tail.classify(df, span=8).collect()}
    inode, size = None, 0
    for _, i, there, node, n in polls:
        assert got[i] == (inode, size)
        if there:
            inode, size = node, n
    asked = [(i, "x", [-1, 3, -5, 0][i % 4] if i > 5 else -1) for i in range(40)]
    df = throttle.settings(spark.createDataFrame(asked, "at bigint, who string, s int"), "s", "at", ["who"], span=6)
    now, got = 0, {r["at"]: r.in_force for r in df.collect()}
    for at, _, s in asked:
        now = s if s >= 0 else now
        assert got[at] == now
