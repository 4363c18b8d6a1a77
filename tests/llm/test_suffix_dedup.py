import random
from hashlib import sha256

import numpy as np
import pytest
from brute import removed
from pyspark.sql import functions as F

from logweave.llm import suffix_dedup
from logweave.llm.suffix_dedup import cleaned, dedup, digests


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ ") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))[:n]
    shared = [prose(rng.choice([399, 400, 401, 450, 900, 2500])) for _ in range(5)]
    out = ["", None, "a" * 3000, "ab" * 700, "x" * 399, "x" * 400]
    for _ in range(40):
        parts = [prose(rng.randrange(0, 1200))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            if rng.random() < 0.5:
                a = rng.randrange(len(p))
                p = p[:a] + rng.choice("xyz") + p[a + 1 :]
            parts += [p, prose(rng.randrange(0, 700))]
        out.append("".join(parts))
    base = prose(4000)
    for _ in range(6):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = "Z"
        out.append("".join(near))
    return out + out[10:13]


@pytest.mark.parametrize(("seed", "parts"), [(1, 4096), (2, 4096), (3, 1), (4, 40)])
def test_equals_brute_force(spark, seed, parts, monkeypatch):
    """parts: with 1 no rank is hot, with 4,096 every one, with 40 some are."""
    monkeypatch.setattr(suffix_dedup, "PARTS", parts)
    texts = fixture(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in digests(df).collect()}
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 400)
    for r in rows.values():  # the text that is left is the one of the digest
        assert r.text is None or sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert sum(r.text is None for r in rows.values()) < len(rows) / 2


@pytest.mark.parametrize("span", [32, 47, 200, 640])
def test_other_spans(spark, span):
    texts = fixture(span)
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), span=span).collect()}
    want = removed(texts, span)
    for i, (size, gone, spans, digest) in enumerate(want):
        assert (len(got[i].kept), len(got[i].spans), sha256(bytes(got[i].kept)).hexdigest()) == (size - gone, spans, digest)


def test_spans_out_of_range(spark):
    for span in (31, 1001):
        with pytest.raises(ValueError, match="span"):
            dedup(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), span=span)


def first_kept(texts, n):
    """What is left of each text if a word goes that lies in a string of n words with an earlier copy."""
    seen, out = set(), []
    for t in texts:
        ws = (t or "").split()
        gone = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            g = tuple(ws[i : i + n])
            if g in seen:
                gone[i : i + n] = [True] * n
            seen.add(g)
        out.append([w for w, g in zip(ws, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 50), (2, 50), (3, 12), (4, 4)])
def test_first_copy_of_words_stays(spark, seed, n):
    rng = random.Random(seed)
    prose = lambda k: [rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(400)) for _ in range(k)]
    shared = [prose(rng.choice([n - 1, n, n + 1, 2 * n, 5 * n])) for _ in range(5)]
    texts = ["", None, "a " * 5 * n, " ".join(["x", "y"] * n)]
    for _ in range(40):
        parts = prose(rng.randrange(3 * n))
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(shared))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "new"
            parts += p + prose(rng.randrange(2 * n))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    near = prose(30 * n)
    for _ in range(6):
        near[rng.randrange(len(near))] = "edit"
        texts.append(" ".join(near))
    texts += texts[9:12]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, found string")
    rows = {r.doc_id: r.text for r in cleaned(df, n).collect()}
    for i, want in enumerate(first_kept(texts, n)):
        assert rows[i].split() == want
        if want == (texts[i] or "").split():
            assert rows[i] == (texts[i] or "")


def test_slabs(spark, monkeypatch):
    import logweave.llm.suffix_dedup as s

    texts = [t or "" for t in fixture(5)]
    monkeypatch.setattr(s, "SLAB", 700)
    for t in texts:
        data = t.encode()
        starts = set()
        for anchor, low, high, *_ in s.anchored(s.of_bytes(t)):
            for a, lo, hi in zip(anchor, low, high, strict=True):
                mine = set(range(a - hi, a - lo + 1))
                assert not mine & starts
                starts |= mine
        assert starts == set(range(max(0, len(data) - 399)))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, found int")
    assert digests(empty).count() == 0
    twice = spark.createDataFrame([(1, "q" * 500), (1, "q" * 500), (None, "r" * 399)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in digests(twice).collect()) == [(0, 0), (1, 500), (1, 500)]
    assert {bytes(r.kept) for r in dedup(twice).collect()} == {b"", b"r" * 399}
    words = " ".join(f"é{i}" for i in range(60))
    rich = spark.createDataFrame([(1, words, "x", 300, 5), (2, "own\n" + words + "  end", None, 300, 6), (2, "own\n" + words + "  end", "z", 300, 7), (None, None, "y", None, 8)], "doc_id bigint, text string, found string, n_chars bigint, doc_key int")
    rows = sorted(cleaned(rich).collect(), key=lambda r: r.doc_key)
    assert [tuple(r) for r in rows] == [(1, words, "x", len(words), 5), (2, "own\nend", None, 7, 6), (2, "own\nend", "z", 7, 7), (None, "", "y", 0, 8)]
    assert cleaned(rich.limit(0)).count() == 0


def unmixed(y):
    """The value that `_mix` makes y of."""
    m = (1 << 64) - 1

    def unshift(x, k):
        out = x
        for _ in range(64 // k + 1):
            out = x ^ out >> k
        return out

    y = unshift(y, 33)
    y = unshift(y * pow(0x81DADEF4BC2DD44D, -1, 1 << 64) & m, 27)
    return unshift(y * pow(0x7FB5D329728EA185, -1, 1 << 64) & m, 31)


def test_orders_of_two_words_that_sums_of_powers_confuse(spark, monkeypatch):
    """Two words whose mixed values agree in 44 bits, in a Thue-Morse order and in the reverse of it: both texts' middles are there once, and stay."""
    import logweave.llm.suffix_dedup as s

    x = 0x0123456789ABCDEF
    names = {"tock": unmixed(x), "tick": unmixed(x + (1 << 44))}
    plain = s.of_words
    monkeypatch.setattr(s, "of_words", lambda text: np.array([names.get(w, int(h)) for w, h in zip(text.split(), plain(text), strict=True)], np.uint64))
    order = [bin(i).count("1") % 2 for i in range(32)]
    middles = [[("tick", "tock")[b ^ flip] for b in order] for flip in (0, 1)]
    both = [s.Names(s.of_words(" ".join(m))) for m in middles]
    ends = np.array([0]), np.array([32])
    assert both[0].of(*ends) == both[1].of(*ends)  # the first name alone is confused
    assert both[0].of(*ends, 1) != both[1].of(*ends, 1)
    around = [" ".join(f"{side}{i}" for i in range(300)) for side in "ab"]
    texts = [f"{around[0]} {' '.join(m)} {around[1]}" for m in middles]
    named = [s.Names(s.of_words(t)) for t in texts]
    ends = np.array([0]), np.array([632])
    assert named[0].of(*ends, 1) != named[1].of(*ends, 1)


def test_rows_of_a_hot_key_are_dealt_over_pieces(spark, monkeypatch):
    """A key of half of all rows, many of a few rows, one without rows: the same rows as a plain join, the hot key's in many pieces."""
    monkeypatch.setattr(suffix_dedup, "PARTS", 64)
    rows = spark.range(20_000).selectExpr("id", "if(id % 2 = 0, -1, id % 3000) as k", "id as place")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).where("k = -1 or k % 3 = 0")
    got = suffix_dedup.known(rows, keys, ["k"], ["id", "place"])
    assert sorted(r.id for r in got.collect()) == [i for i in range(20_000) if i % 2 == 0 or i % 3000 % 3 == 0]
    joined = suffix_dedup.known(rows, keys.withColumn("more", F.col("k") + 1), ["k"], ["id"], "inner").select("id", "k", "more").collect()
    assert len(joined) == got.count() and all(r.more == r.k + 1 for r in joined)
    assert suffix_dedup.known(rows, keys.where("false"), ["k"], ["id"]).isEmpty()
    dealt = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "LeftSemi" in x)
    assert "_piece" in dealt
