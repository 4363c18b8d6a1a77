import random
import re
from collections import Counter

import pytest

from logweave.llm import quality_classifier, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def test_nearest_equals_all_cosines():
    rng = random.Random(2)

    def vector():
        ts = sorted(rng.sample(range(30), rng.randrange(1, 8)))
        ws = [rng.random() + 0.1 for _ in ts]
        norm = sum(w * w for w in ws) ** 0.5
        return tuple((t, w / norm) for t, w in zip(ts, ws, strict=True))

    examples = [toxicity.Example(i, vector(), 1, i % 2) for i in range(1500)]
    index = toxicity.Index(examples)
    for _ in range(100):
        q = vector()
        mine = dict(q)
        # summed in the same order, so that ties stay ties
        whole = [(round(min(1.0, sum(mine[t] * w for t, w in e.vector if t in mine)), 12), -i) for i, e in enumerate(examples)]
        got = index.nearest(q)
        assert got == sorted((x for x in whole if x[0] > 0), reverse=True)[: toxicity.NEAREST]


@pytest.mark.parametrize(("sf_dir", "recall"), [(SF, 0.5), ("/root/testdata/sf0.1", 0.9)])
def test_toxicity_on_held_out_labels(spark, sf_dir, recall):
    """The smaller table has too few labels to know most insults of the smaller languages."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.judged(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    hit = sum(r.predicted and truth[r.doc_id] for r in rows)
    said, there = sum(r.predicted for r in rows), sum(truth[r.doc_id] for r in rows)
    assert hit >= 0.9 * said
    assert hit >= recall * there


def test_toxicity_sees_every_term(spark):
    """Words that don't go with the label are in the vectors, too, and a clean text with a toxic word isn't the same as this word alone."""
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(words, 20) + ["insult"] * (i % 10 == 3)), int(i % 10 == 3)) for i in range(300)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    near = {r[0] for r in labels.where(~toxicity.is_held_out(labels.doc_id)).collect()}
    twin = next(r for r in rows if r[0] in near and r[0] % 5 and not r[2])
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, twin[1] + " new"), (1001, "insult"), (1002, " ".join(words) + " insult")], "doc_id bigint, text string")
    model = toxicity.fit(docs, labels)
    assert set(model.terms) == {w for i, text, _ in rows if i in near for w in text.split()}
    assert model.vector("insult") != model.vector(" ".join(words) + " insult")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[1000].evidence[0].doc_id == twin[0]
    assert got[1000].evidence[0].cosine > 0.99
    # the nearest five, by all cosines
    for doc_id, text in docs.collect():
        mine = dict(zip(*(a.tolist() for a in toxicity.arrays(model.vector(text))), strict=True))
        every = [(sum(mine.get(t, 0) * w for t, w in zip(*(a.tolist() for a in toxicity.arrays(e.vector)), strict=True)), e.doc_id) for e in model.examples]
        want = sorted((c for c, _ in every), reverse=True)[:5]
        assert [e.cosine for e in got[doc_id].evidence] == pytest.approx([c for c in want if c > 0], abs=1e-9)


def test_quality_sees_every_character():
    """Words that differ only past their 64th character."""
    q = quality_classifier
    for a, b in (("漢" * 64 + "字" * 9, "漢" * 64 + "語" * 9), ("漢字" * 5000 + "、字", "漢字" * 5000 + "。字"), ("+/" * 90 + "a", "+/" * 90 + "7")):
        s = q.measure(a)
        f, g = q.features(a, s, q.Shapes()), q.features(b, s, q.Shapes())
        assert f != g
    assert sum(q.long_shape("漢字語" * 500).values()) == pytest.approx(1)


def odd(spark):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (2, None, None), (3, "", 3), (None, "x\ny\nx\n \n", 4), (5, "Häh    #* <b> é😀\r\n" * 40, 5), (6, "w " * 200_000, 6), (7, "a b c a b c a b c d", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, votes int").selectExpr("*", "'z' as n_words", "1 as score", "2 as toxic", "3 as kept")


@pytest.mark.parametrize("judge", [lambda d: quality_classifier.classify(d)[0], lambda d: quality_rules.apply_rules(d)[0], lambda d: toxicity.judged(d, d.selectExpr("doc_id", "cast(null as int) as toxic"))])
def test_odd_rows(spark, judge):
    df = odd(spark)
    assert Counter(r.doc_id for r in judge(df).collect()) == Counter([1, 1, 2, 3, None, 5, 6, 7])
    assert judge(df.limit(0)).count() == 0


def base(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), again, len(hit), len(ws) < 50 or 100 * len(hit) > 50 * len(ws))


def test_base_equals_brute_force(spark):
    for df in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        want = Counter((r.doc_id, *base(r.text)) for r in df.select("doc_id", "text").collect())
        rows = quality_rules.apply_rules(df)[0].collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert got == want
        assert not any(r.base_failed and r.kept for r in rows)
