import random

import numpy as np
import pytest

from logweave.llm import common, ngram_join

SCHEMA = "doc_id bigint, text string, uid string, comp long, n_shingles string"
WORDS = [f"w{i}" for i in range(500)]


def shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    """Per row: (doc_id, n_shingles, component_id), from all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    above[root(i)] = root(j)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return sorted(out, key=str)


def joined(spark, rows):
    df = ngram_join.linked(spark.createDataFrame(rows, SCHEMA).repartition(6))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def corpus(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        if i > 5 and rng.random() < 0.6:
            out.append(edited(rng, rng.choice(out), rng.choice([0.005, 0.01, 0.02, 0.03, 0.04])))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 20, 60, 150, 400]))))
    return [(i, t, "x", 1, "y") for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(400, seed)
    want = plain(rows)
    assert len({c for *_, c in want}) < 380  # there are links
    assert joined(spark, rows) == want


def test_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "FANOUT", 2)
    rng = random.Random(3)
    base = " ".join(rng.choice(WORDS) for _ in range(120))
    chain, texts = base, []
    for i in range(150):  # a long chain: neighbours are linked, its ends are not
        if i % 3 == 0:
            chain = edited(rng, chain, 0.01)
        texts.append(chain if i % 5 else edited(rng, base, rng.choice([0.01, 0.03, 0.06])))
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    assert joined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    word = "One two\tthree\x0bfour five"
    rows = [(1, None, "x", 1, "y"), (2, "", "x", 1, "y"), (3, " \n\t", "x", 1, "y"), (3, " \n\t", "x", 1, "y"), (9, word, "x", 1, "y"), (5, word.upper(), "x", 1, "y"), (5, word.upper(), "x", 1, "y"), (None, word, "x", 1, "y")]
    rows += [(7, "one", "x", 1, "y"), (8, "ONE", "x", 1, "y"), (10, "one two", "x", 1, "y"), (None, "alone here", "x", 1, "y"), (11, "ÉTÉ été", "x", 1, "y"), (12, "ÉtÉ éTé", "x", 1, "y"), (13, "a b c d e", "x", 1, "y")]
    rows += [(20, " ".join(WORDS * 40), "x", 1, "y"), (21, " ".join(WORDS * 40 + ["more"]), "x", 1, "y"), (22, "again " * 3000, "x", 1, "y")]
    assert joined(spark, rows) == plain(rows)
    assert joined(spark, []) == []


@pytest.mark.parametrize("n", [5, 13, 14, 20, 33, 100, 333, 2000])
def test_linked_sets_share_a_tree_and_pass_the_bounds(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        both = int(rng.integers(1, n + 1))
        a, b = (np.unique(np.concatenate((np.arange(both, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n), rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 6) + 1)), np.uint64)))) for _ in "ab")
        if not ngram_join.linked_sets(a, b) or (len(a) == len(b) and (a == b).all()):
            continue
        shared = set(ngram_join.keys(a).tolist()) & set(ngram_join.keys(b).tolist())
        assert shared
        kind = min(int(np.searchsorted(ngram_join._LEAST, len(x), "right")) - 1 for x in (a, b))
        made = [(i, i, len(x), i, ngram_join.bitmap(x, ngram_join.bits_of(kind))) for i, x in enumerate((a, b))]
        tree = ngram_join.Tree(made, len(made[0][4]))
        i, j, most = ngram_join.survivors(tree, tree)
        assert list(zip(i, j, strict=True)) == [(0, 1)] and most[0] >= len(np.intersect1d(a, b))


def test_traversal_finds_all_the_pairs_that_bounds_leave(monkeypatch):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 200, np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) > 0.04], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), np.uint64)))) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 1 << 63, 190, np.uint64)) for _ in range(60)]
    made = [(i, i, len(x), int(x[0] >> np.uint64(1)), ngram_join.bitmap(x, 2048)) for i, x in enumerate(sets)]
    for fan in (2, 3, 8):
        monkeypatch.setattr(ngram_join, "FANOUT", fan)
        a, b = ngram_join.Tree(made[:70], 256), ngram_join.Tree(made[70:], 256)
        for x, y in ((a, a), (a, b), (b, a)):
            i, j, _ = ngram_join.survivors(x, y)
            got = {tuple(sorted((int(x.uid[p]), int(y.uid[q])))) for p, q in zip(i, j, strict=True)}
            pool = [(int(p), int(q)) for p in x.uid for q in y.uid if x is not y or p < q]
            need = {tuple(sorted(p)) for p in pool if ngram_join.linked_sets(sets[p[0]], sets[p[1]])}
            assert need <= got and len(got - need) < len(pool) / 2


def test_twins_and_unwanted_texts_are_left_out_before_shuffles(spark, monkeypatch):
    """Trees hold no set twice and no set alone; only texts in trees are read again; with bitmaps that are nearly full results are the same."""
    rng = random.Random(7)
    alone = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(200)]
    near = [edited(rng, alone[0], 0.01) for _ in range(3)]
    twins = [t.upper() for t in alone[:40]]  # equal sets, other texts
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(alone + near + twins)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("text", "unhex(md5(text)) AS text_key").repartition(4)
    signed = ngram_join.signatures(df)
    first = signed.groupBy("node").agg({"uid": "min"}).withColumnRenamed("min(uid)", "first")
    twin = signed.join(first, "node").where("uid <> first").select("uid")
    assert twin.count() == 40
    members = ngram_join.trees(signed, twin)
    assert members.groupBy("key").count().where("count < 2").isEmpty()
    assert members.select("uid").distinct().count() == 4  # the first text and its near copies
    asked = df.where("text = upper(text)").select("text_key")
    kept = common.likely(df, "text_key", asked)
    assert kept.join(asked, "text_key", "left_semi").count() == 40 and kept.count() < 50
    assert common.likely(df, "text_key", asked.where("false")).isEmpty()
    monkeypatch.setattr(common, "MAPS", 1)
    want = plain(rows)
    assert joined(spark, rows) == want
