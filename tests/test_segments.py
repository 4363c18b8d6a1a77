"""Segmented ordered maps against plain dictionaries."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logweave.operators.segments import entries, lookup, merge, numbers, segments_of

CHUNK = "id string, session bigint, seq bigint, value string"
row = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(-9, 20)), st.one_of(st.none(), st.text("xyz", max_size=2)))


def plain(*sides):
    """The later side wins; within a side the largest value, nulls least."""
    out = {}
    for k, rows in enumerate(sides):
        mine = {}
        for id, session, seq, value in rows:
            if seq is not None:
                old = mine.get((id, session, seq))
                mine[id, session, seq] = value if old is None else old if value is None else max(old, value)
        for key, value in mine.items():
            out[key] = (value, key in out)
    return out


@pytest.mark.parametrize("span", [1, 4, 16])
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(st.lists(row, max_size=30), min_size=1, max_size=3))
def test_merge_equals_dictionaries(spark, span, data):
    maps = [segments_of(spark.createDataFrame(rows, CHUNK), "value", span=span) for rows in data]
    got = entries(merge(*maps), "value", span).collect()
    assert {(r.id, r.session, r.seq): (r.value, r.shared) for r in got} == plain(*data)
    assert len(got) == len(plain(*data))


def test_segments_are_sorted_and_bounded(spark):
    """One log with nearly all rows is many segments, of which each number is there once."""
    rng = random.Random(3)
    rows = [("hot", 1, rng.randrange(-500, 5000), str(i)) for i in range(8000)] + [("cold", 1, (1 << 60) + 1, "x")]
    held = segments_of(spark.createDataFrame(rows, CHUNK), "value", span=64).collect()
    assert len(held) > 80 and {r.id for r in held} == {"hot", "cold"}
    for r in held:
        assert list(r["at"]) == sorted(set(r["at"])) and 0 <= min(r["at"]) and max(r["at"]) < 64 and len(r["at"]) == len(r["values"])
    with pytest.raises(ValueError):
        segments_of(spark.createDataFrame(rows, CHUNK), "value", span=7)


def test_last_arrival_stays(spark):
    rows = [("a", 1, 1, "z", 1), ("a", 1, 1, "b", 2), ("a", 1, 300, None, 2), ("a", 1, 300, "q", 1)]
    held = segments_of(spark.createDataFrame(rows, CHUNK + ", came int"), "value", "came")
    assert {(r.seq, r.value) for r in entries(held, "value").collect()} == {(1, "b"), (300, None)}


def test_lookup_and_numbers(spark):
    rows = [("a", 1, 3, "x"), ("a", 1, 700, None), (None, None, -5, "n")]
    held = segments_of(spark.createDataFrame(rows, CHUNK), "value")
    wanted = spark.createDataFrame([("a", 1, 3, "one"), ("a", 1, 4, "two"), ("a", 1, 700, "three"), (None, None, -5, "four"), ("a", 1, None, "five"), ("b", 1, 3, "six")], "id string, session bigint, seq bigint, value_of string")
    assert {(r.value_of, r.value, r.found) for r in lookup(held, wanted, "value").collect()} == {("one", "x", True), ("two", None, False), ("three", None, True), ("four", "n", True), ("five", None, False), ("six", None, False)}
    assert {tuple(r) for r in numbers(held).collect()} == {("a", 1, 3, 700, 2), (None, None, -5, -5, 1)}


def test_empty(spark):
    none = segments_of(spark.createDataFrame([], CHUNK), "value")
    assert entries(merge(none, none), "value").count() == 0 and numbers(none).count() == 0
