import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from logweave.llm.best_fit import pack, pack_documents


def plain(items, capacity, per_source):
    """The same choice by a look at every bin: the least room, then the bin that has had this room longest."""
    bins, out = [], []
    for now, (size, source, cluster) in enumerate(items):
        fits = [(b["room"], b["at"], i) for i, b in enumerate(bins) if b["room"] >= size and b["sources"][source] < per_source and cluster not in b["clusters"]]
        if fits:
            i = min(fits)[2]
        else:
            i = len(bins)
            bins.append({"room": capacity, "sources": Counter(), "clusters": set()})
        b = bins[i]
        b["room"], b["at"] = b["room"] - size, now
        b["sources"][source] += 1
        b["clusters"].add(cluster)
        out.append(i)
    return out


def test_equals_plain_search():
    rng = random.Random(7)
    for _ in range(60):
        items = sorted(((rng.randrange(1, 101), rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(25)) for _ in range(rng.randrange(150))), reverse=True)
        assert pack(items, 100, 3) == plain(items, 100, 3)


def test_bins(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w" + str(rng.randrange(9))] * rng.randrange(0, 90)), rng.choice(["a", "a", "b", None]), "x") for i in range(300)]
    rows += [(1000, "v " * 1234, "a", "x"), (1001, None, None, None), (1001, None, None, None), (None, "n m", "a", "y"), (2**62 + 1, "k l", "b", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, bin_id string")
    got = pack_documents(df, capacity=100, per_source=4, shard_docs=100).collect()
    words, sources, texts = defaultdict(int), defaultdict(Counter), defaultdict(list)
    by_id = {r[0]: r for r in rows}
    for r in got:
        words[r.bin_id] += max(1, r.n_words)
        sources[r.bin_id][by_id[r.doc_id][2]] += 1
        texts[r.bin_id].append(by_id[r.doc_id][1] or "")
    assert max(words.values()) <= 100
    assert all(max(c.values()) <= 4 for c in sources.values())
    assert all(len(t) == len(set(t)) for t in texts.values())
    pieces = Counter(r.doc_id for r in got)
    assert pieces[1000] == 13 and pieces[1001] == 2 and pieces[None] == 1 and pieces[2**62 + 1] == 1
    assert all(pieces[i] == 1 for i in range(300))
    assert pack_documents(df.limit(0)).count() == 0


def test_repeated_rows_have_bins_of_their_own(spark):
    """Full pieces of equal rows, with ids and without, and huge texts among the copies."""
    rows = [(i, "w " * n) for i in (5, 5, None, None) for n in (200, 250)] + [(6, "w " * 100)] * 3
    got = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s")), capacity=100).collect()
    assert len(got) == 4 * 2 + 4 * 3 + 3
    words = defaultdict(int)
    for r in got:
        words[r.bin_id] += r.n_words
    assert max(words.values()) == 100
    assert all(r.n_bin_words == words[r.bin_id] for r in got)
    assert sum(n == 100 for n in words.values()) == 8 + 8 + 3
