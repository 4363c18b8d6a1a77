from itertools import permutations

from logweave.llm import interaction_audit

DOCS = "doc_id bigint, text string, lang string, n long, filter string, part string"
LABELS = "doc_id bigint, quality int, toxic int"


def plain(docs, labels):
    """Counts by walking every order document by document."""
    import re

    least, rows = {}, []
    for d in docs:
        if d[0] is not None:
            t = d[1] or ""
            least[t] = min(least.get(t, d[0]), d[0])
    for doc_id, text, lang, *_ in docs:
        t = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = ""
        fails += "A" if len(w) < 100 else ""
        fails += "B" if 100 * len(set(w)) < 80 * len(w) else ""
        fails += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else ""
        fails += "D" if any(c in "#$%&*|" for c in t) else ""
        fails += "E" if doc_id is not None and least[t] < doc_id else ""
        mine = [x for x in labels if doc_id is not None and x[0] == doc_id]
        rows.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = mine
            for k, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                out[part, "".join(order), k] = [len(alive), len(gone), failing - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row.insert(6, shapley[row[-1]])
    return out


def audited(spark, docs, labels):
    rows = interaction_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley, r["filter"]] for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_walks_of_every_order(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, long, "en", 1, "x", "y"), (2, long, "en", 1, "x", "y"), (2, long, "en", 1, "x", "y"), (3, long, "de", 1, None, "y"), (None, long, "en", 1, "x", "y"),
        (4, None, "en", 1, "x", "y"), (5, "", None, 1, "x", "y"), (6, "", "", 1, "x", "y"), (7, "a " * 150, "en", 1, "x", "y"), (8, "SHOUT " * 3, "de", 1, "x", "y"),
        (9, long + " $5 #", "de", 1, "x", "y"), (10, "AÉß \U0001f600 |", "fr", 1, "x", "y"), (11, " \t\x0b\x0c\r\n", "fr", 1, "x", "y"), (1, long, "fr", 1, "x", "y"), (12, long.upper(), "en", 1, "x", "y"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (99, 1, 1), (None, 1, 1), (8, 0, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_hot_text_and_empty_tables(spark):
    docs = [(i, "the same" if i % 3 else f"own text {i}", "en" if i % 2 else None, 1, "x", "y") for i in range(400)]
    assert audited(spark, docs, []) == plain(docs, [])
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_every_order_has_every_filter_once():
    rows = interaction_audit.steps()
    assert len(rows) == 600 and len({(o, k) for o, k, *_ in rows}) == 600
    assert len({(b, a) for *_, b, a in rows}) == 80
