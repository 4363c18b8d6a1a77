import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_minhash import brute

from logweave.llm import best_fit, minhash, quality_classifier, suffix_dedup, toxicity
from logweave.llm.common import text_key

SF = "/root/testdata/sf0.001"


def test_rows_are_judged_each(spark):
    """Null and shared ids with different texts: what stays is what each text's own verdict keeps."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, ""), (None, None), *((None, text) for _, text in rows[:60]), *((7, text) for _, text in rows[60:120]), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.text_key: r.kept for r in quality_classifier.classify(docs, with_key=True)[0].collect()}
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_low_quality(spark, docs, SF).collect())
    assert got == Counter(r for r in rows if kept[text_key(r[1])])
    assert (None, "") not in got
    assert sum(n for (i, _), n in got.items() if i is None) > 10
    assert sum(n for (i, _), n in got.items() if i == 7) > 10
    toxic = {r.text_key: r.predicted for r in toxicity.judged(docs, spark.read.parquet(f"{SF}/labels.parquet"), with_key=True).collect()}
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect())
    assert got == Counter(r for r in rows if not toxic[text_key(r[1])])


def without_repeats(rows, span):
    """Texts by id: every word covered by a string of span words that is at an earlier place, too (least id, then place), goes."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words, gone = text.split(), set()
        for i in range(len(words) - span + 1):
            window = tuple(words[i : i + span])
            if window in seen:
                gone.update(range(i, i + span))
            seen.add(window)
        lead, tokens = re.match(r"\s*", text)[0], re.findall(r"\S+\s*", text)
        out[doc_id] = lead + "".join(t for i, t in enumerate(tokens) if i not in gone)
    return out


def test_whole_run(spark):
    """run() against each stage done plainly: verdicts by text, classes by all pairs, repeats by all windows, bins by their rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    toxic = {r.doc_id for r in toxicity.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    clean = spark.createDataFrame([r for r in docs.collect() if r.doc_id not in toxic], docs.schema)
    good = {r.doc_id for r in quality_classifier.classify(clean)[0].where("kept").collect()}
    good_docs = clean.where(clean.doc_id.isin(sorted(good)))
    rows = sorted((r.doc_id, r.text) for r in good_docs.collect())
    classes = brute(rows, minhash.word_factors(good_docs))
    rows = [r for r in rows if classes[r[0]] == r[0]]
    texts = without_repeats(rows, suffix_dedup.WORDS)
    # This table has too few labels for a text to be found toxic (other tests have larger tables); the next two stages take rows.
    assert len(toxic) < docs.count() - len(good) < docs.count() - len(texts)

    want = Counter()
    for doc_id, text in texts.items():
        n = len(re.findall(r"\S+", text, re.ASCII))
        for piece in range(max(1, -(-n // best_fit.CAPACITY))):
            first = piece * best_fit.CAPACITY
            want[doc_id, piece, first, min(best_fit.CAPACITY, n - first)] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.first_word, r.n_words) for r in got) == want

    source = {r.doc_id: r.source for r in docs.collect()}
    words, sources, held = Counter(), defaultdict(Counter), defaultdict(list)
    for r in got:
        words[r.bin_id] += r.n_words
        sources[r.bin_id][source[r.doc_id]] += 1
        held[r.bin_id].append(" ".join(texts[r.doc_id].lower().split()))
    assert all(words[r.bin_id] == r.n_bin_words <= best_fit.CAPACITY for r in got)
    assert all(max(c.values()) <= best_fit.PER_SOURCE for c in sources.values())
    assert all(len(t) == len(set(t)) for t in held.values())
