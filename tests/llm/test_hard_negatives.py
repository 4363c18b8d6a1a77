import math
import random

import numpy as np
import pytest

from logweave.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, score long, dist string"


def plain(rows, every=100, k=5, m=5):
    used = set()
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = set()
    for a, label, v in used:
        if a % every:
            continue
        s = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for i, other, w in used]
        for p, i in sorted((p, i) for p, i, same in s if same and i != a)[:k]:
            fit = sorted((n, j) for n, j, same in s if not same and 80 * -p <= 100 * -n <= 100 * -p)[:m]
            out |= {(a, i, r, j, -p, -n) for r, (n, j) in enumerate(fit, 1)}
    return out


def mined(spark, rows, every=100, **more):
    df = hard_negatives.prepared(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = [tuple(r) for r in hard_negatives.mined(df, f"vec_id % {every} = 0", **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(n, size, labels, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [(i, [float(np.float32(c + spread * rng.gauss(0, 1))) for c in centres[rng.randrange(6)]], rng.randrange(labels), 1, "x") for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_against_all_pairs(spark, spread, monkeypatch):
    rows = vectors(600, 8, 4, 1, spread)
    # Small blocks, so that groups and blocks are many and bounds leave some out.
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK", 100)
    monkeypatch.setattr(hard_negatives, "TILE", 3)
    assert mined(spark, rows, every=10) == plain(rows, every=10)


def test_hot_vector_ties_repeats_and_odd_rows(spark):
    rows = vectors(300, 4, 3, 2)
    hot = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, hot, i % 2, s, d) if i % 3 == 0 else (i, v, y, s, d) for i, v, y, s, d in rows]
    rows += rows[:20]  # repeated rows
    rows += [(300, None, 1, 1, "x"), (400, [1.0, None, 0.0, 0.0], 1, 1, "x"), (500, [float("nan"), 0.0, 0.0, 0.0], 1, 1, "x"), (600, [float("inf"), 0.0, 0.0, 0.0], 1, 1, "x"), (700, hot, None, 1, "x"), (None, hot, 1, 1, "x")]
    rows += [(800, [], 1, 1, "x"), (801, [0.0, 0.0], 1, 1, "x"), (802, [0.0], 2, 1, "x"), (900, [9.0, 1.0], 2, 1, "x"), (901, [9.0, 1.0, 0.5, 0.5], 2, 1, "x"), (1, [3.0, 1.0, 0.0, 0.0], 2, 1, "x")]
    assert mined(spark, rows, every=10) == plain(rows, every=10)


def test_one_label_few_rows_and_empty(spark):
    one = vectors(50, 3, 1, 3)
    one = [r for r in one if r[0] % 7]  # one label: no negatives
    assert mined(spark, one, every=10) == set() == plain(one, every=10)
    two = [(0, [1.0], 3, 1, "x"), (100, [1.0], 4, 1, "x"), (3, [0.875], 5, 1, "x")]
    assert mined(spark, two) == plain(two) != set()
    assert mined(spark, []) == set()


def test_pruning_leaves_rows_out(spark):
    """In cells far apart a group is served by few rows, and still gets all its own."""
    rows = [(i, [10.0 if k == i % 5 else float(np.float32(0.1 * math.sin(i + k))) for k in range(5)], (i // 5) % 3, 1, "x") for i in range(500)]
    assert mined(spark, rows, every=20) == plain(rows, every=20)


def test_exact_scores():
    big = [[1 << 30, 3], [-(1 << 30), 7]]
    assert hard_negatives.scores(big, big).tolist() == [[sum(x * y for x, y in zip(a, b, strict=True)) for b in big] for a in big]
    assert [hard_negatives.least_negative(s) for s in (0, 1, 5, 6, 100)] == [0, 1, 4, 5, 80]
