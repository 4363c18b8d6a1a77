import random

from logweave.operators import digest_tree

SCHEMA = "id string, n int, line string"


def plain(a, b):
    x, y = ({(i, n): v for i, n, v in rows} for rows in (a, b))
    out = set()
    for k in x.keys() | y.keys():
        if k not in y or k not in x or x[k] != y[k]:
            out.add((*k, x.get(k), y.get(k), "changed" if k in x and k in y else "source" if k in x else "rebuilt"))
    return out


def test_differences_equal_a_loop(spark):
    rng = random.Random(1)
    a = [(f"log{i}", n, rng.choice(["", None, "x", f"line {n}"])) for i in range(6) for n in range(rng.choice([0, 1, 3, 40, 200]))]
    b = []
    for i, n, v in a:
        if i == "log1" or rng.random() > 0.03:
            b.append((i, n, v if i in ("log1", "log2") or rng.random() > 0.05 else "other"))
    b += [("new", 0, "only here"), ("log3", 900, "far behind"), ("log4", 901, None)]
    x, y = (spark.createDataFrame(t, SCHEMA).repartition(3) for t in (a, b))
    want = plain(a, b)
    for leaf, fanout in ((4, 3), (256, 64)):
        got = {tuple(r) for r in digest_tree.differences(x, y, ["id"], "n", "line", leaf, fanout).select("id", "n", "source", "rebuilt", "side").collect()}
        assert got == want
    same = {r.id: r.equal for r in digest_tree.equal(x, y, ["id"], "n", "line").collect()}
    assert same == {i: i not in {w[0] for w in want} for i in {r[0] for r in a + b}}


def test_only_unequal_leaves_are_open(spark):
    rows = [("l", n, f"line {n}") for n in range(1000)]
    swapped = [(i, {500: 501, 501: 500}.get(n, n), v) for i, n, v in rows]
    x, y = (spark.createDataFrame(t, SCHEMA) for t in (rows, swapped))
    leaves = digest_tree.unequal(digest_tree.tree(x, ["id"], "n", "line", 10, 4), digest_tree.tree(y, ["id"], "n", "line", 10, 4), ["id"], 4)
    assert [tuple(r) for r in leaves.collect()] == [("l", 50)]
    assert digest_tree.differences(x, x, ["id"], "n", "line").isEmpty()
