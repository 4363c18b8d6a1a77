import random
from collections import Counter
from itertools import combinations

import numpy as np

from logweave.llm import minhash as m

SCHEMA = "doc_id bigint, text string"


def brute(rows, factor):
    """Class id of each id: chains of pairs with a weighted Jaccard of at least 0.8, by dictionaries of word tuples."""
    bags = []
    for _, text in rows:
        ws = m.terms(text)
        k = min(5, len(ws))
        n = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter()
        bags.append({g: c * (1 + sum(factor[m.word_hash(w) % m.DF_BUCKETS] for w in g) / k) for g, c in n.items()})
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = bags[i], bags[j]
        both = sum(min(w, b[g]) for g, w in a.items() if g in b)
        if (rows[i][1] or "") == (rows[j][1] or "") or both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) > 0:
            group[max(top(i), top(j))] = min(top(i), top(j))
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def fixture(seed):
    """Groups of near copies from almost equal to quite unlike, chains of them, exact copies, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(400)]
    texts = ["", None, "  ", "one", "One", "one two three", "one two three four five six"]
    for size in (1, 2, 5, 40):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 200]))
        for _ in range(size):
            near = list(base)
            for _ in range(rng.randrange(len(base) // 12 + 1)):
                near[rng.randrange(len(near))] = f"own{rng.randrange(10**9)}"
            texts.append(" ".join(near))
    chain = rng.choices(vocabulary, k=150)
    for _ in range(12):
        chain[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(chain))
    texts += texts[8:14]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        factor = m.word_factors(df)
        got = {r.doc_id: r.class_id for r in m.classes(df).collect()}
        # blank texts have no words: only equal ones are one class
        assert got == brute(rows, factor)


def test_own_weights(spark):
    rows = [(bytes([i] * 16), t) for i, t in ((0, "a b c d e f"), (255, "a b c d e g"), (128, "x y z x y z x y z"))]
    df = spark.createDataFrame(rows, "node binary, text string")
    own = {bytes(r.node): r.own for r in m.own_weights(df, spark.sparkContext.broadcast(np.zeros(m.DF_BUCKETS))).collect()}
    assert own == {rows[0][0]: 1, rows[1][0]: 1, rows[2][0]: 5}


def test_edges(spark):
    assert m.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    schema = "doc_id bigint, text string, node string, class int, weight string, first int"
    long = " ".join(map(str, range(60_000)))
    df = spark.createDataFrame([(None, "a b c d e f", "n", 1, "w", 0), (4, "a b c d e f", None, 2, None, 1), (4, "a b c d e f", None, 2, None, 1), (5, None, "", None, "", None), (6, "", "", 1, "", 0), (7, long, "", 1, "", 0), (8, long + " x", "", 1, "", 0)], schema)
    assert sorted((r.doc_id or -1, r.class_id) for r in m.classes(df).collect()) == [(-1, 4), (4, 4), (4, 4), (5, 5), (6, 5), (7, 7), (8, 7)]
    assert sorted(r.doc_id for r in m.keep_first(df).collect()) == [4, 5, 7]
    assert m.keep_first(df).columns == df.columns


def test_draws_are_alike_with_the_weighted_jaccard_similarity():
    """Single and repeated shingles, equal and unlike weights, few and many of them."""
    rng = np.random.default_rng(7)
    for most, n in [(1, 200), (1, 12), (3, 200), (3, 4), (1, 2000)]:
        off = []
        for _ in range(150):
            names = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            a, b = (rng.integers(1, most + 1, n) * (1 + m.DAMP * rng.random(n)) for _ in range(2))
            b = np.where(rng.random(n) < 0.5, a, b)
            x, y = rng.random((2, n)) < 0.9
            x[0] = y[0] = True
            one, two = (names[x], a[x]), (names[y], b[y])
            off.append((m.samples(*one) == m.samples(*two)).mean() - m.jaccard(one, two))
        assert abs(np.mean(off)) < 3.7 * np.std(off) / len(off) ** 0.5


def test_sampling_does_not_look_at_each_draw_of_each_shingle(monkeypatch):
    made, plain = [], m._exponential
    monkeypatch.setattr(m, "_exponential", lambda x: made.append(x.size) or plain(x))
    rng = np.random.default_rng(8)
    for n in (300, 5000):
        made.clear()
        m.samples(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)), 1 + m.DAMP * rng.random(n))
        assert m.BANDS * m.ROWS < sum(made) < 0.5 * n * m.BANDS * m.ROWS


def test_sets_signed_together_are_as_signed_alone():
    rng, sets = np.random.default_rng(11), []
    for n in (1, 2, 5, 40, 700, 3, 6000, 1, 90):
        names = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        sets.append((names, 1 + rng.random(len(names)) * rng.choice([0.25, 0.25, 9])))
    together = m.samples_of(sets)
    assert together.shape == (len(sets), m.BANDS * m.ROWS)
    for (names, weights), row in zip(sets, together, strict=True):
        assert (m.samples(names, weights) == row).all()
    assert (m.bands(together) == [m.bands(row) for row in together]).all()
