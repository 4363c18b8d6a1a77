"""Exact Jaccard join of word n-gram sets by a forest of signature trees, and the components of its links.

A tree's leaves are documents: a bitmap of hashed shingles, and the number of shingles. An inner node holds its leaves' OR-combined bitmap,
their least and greatest size and the greatest number of shingles that share a bit with another of their document. Two nodes' documents
share at most as many shingles as bits are set in both, plus the lesser of those numbers; a dual traversal goes down only where that may be
enough for sizes in the nodes' ranges.

One tree over a corpus would prune little near its root, so there are many: trees that only documents which may link are in together.
Size classes grow by 1 / 0.85, so that linked documents are in the same class or in neighbours. Linked sets differ in at most h elements (h follows
from the class); elements are dealt to more than h parts by their hash, so that two linked sets agree wholly in a part that isn't empty, and that
part names a tree. A document that would be left with h parts or fewer that aren't empty goes by its empty ones, too.

Trees over more than BLOCK documents are cut into blocks of about that size, which are traversed against each other in tasks of their own. To keep a large group of
near copies from giving all its pairs, traversals run in turns, and what proves linked is joined into components before the next:
1. every document in its largest tree, in blocks, each giving a spanning forest of its best pairs; then again with a document for each component,
   until each tree is one block or no links are found;
2. all trees that still hold more than one component: the pairs between components that the bounds leave, if they are not many more than
   the documents, else the best ones;
3. the trees of which pairs are left: all of them.
All pairs are checked on whole sets, so no link between components is lost. What remains costly are very many documents of a
tree that are nearly, but not quite, similar enough.
"""

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import durable, likely, map_rows, texts, told
from logweave.llm.minhash import _mix, components, word_hash

SHINGLE = 4
#: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Documents to a block of a tree, and children to a node.
BLOCK, FANOUT = 1024, 8
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: A tree that has no more surviving pairs than so many a document gives all of them at once.
AT_ONCE = 4
#: Words and texts whose results a Python worker remembers.
MOST_WORDS, MOST_TEXTS = 300_000, 20_000
_U = np.uint64


def words(text: str | None) -> list[bytes]:
    """Words of other than space and \\t to \\r, with A-Z lower-cased; in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    """A text's distinct shingles as sorted 64-bit names."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, _U)

    def __call__(self, text: str | None) -> np.ndarray:
        ws = words(text)
        if not ws:
            return np.zeros(0, _U)
        if len(self.known) > MOST_WORDS:
            self.__init__()
        at = np.fromiter(map(self.known.get, ws, repeat(-1)), np.int64, len(ws))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [ws[i] for i in missing.tolist()]
            for w in new:
                if w not in self.known:
                    n = self.known[w] = len(self.known)
                    if n >= len(self.hashes):
                        self.hashes = np.resize(self.hashes, 2 * n)
                    self.hashes[n] = word_hash(w)
            at[missing] = list(map(self.known.__getitem__, new))
        h, k = self.hashes[at], min(SHINGLE, len(ws))
        n = len(ws) - k + 1
        name = np.full(n, k, _U)  # a shorter text is one shingle, unlike those of four words
        for i in range(k):
            name = _mix(name + h[i : i + n] + _U(i + 1))
        name.sort()
        return name[np.concatenate(([True], name[1:] != name[:-1]))]


def classes() -> list[int]:
    """Least sizes of the size classes; a size's partners are in its class or a neighbour's."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // PERCENT + 1)
    return out


LEAST = classes()
_LEAST = np.array(LEAST)


def differing(kind: int) -> int:
    """In how many elements linked sets may differ, of which one is of this class and the other of this or the next."""
    return (100 - PERCENT) * (LEAST[kind + 1] + LEAST[kind + 2] - 2) // (100 + PERCENT)


def bits_of(kind: int) -> int:
    """Bits of bitmaps in trees of this class and the next: three to six a shingle of the largest."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (3 * LEAST[kind + 2] - 1).bit_length()))


def keys(names: np.ndarray) -> np.ndarray:
    """The trees of a set, as 64-bit names: those of its class and of the one before."""
    kind = int(np.searchsorted(_LEAST, len(names), "right")) - 1
    out = []
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_mix(names ^ _U(0x9E3779B97F4A7C15)), dtype=_U)))
    for k in (kind - 1, kind):
        if k < 0 or not (h := differing(k)):
            continue  # then only equal sets are linked
        parts = h + 2 + h // 50
        at = ((names >> _U(33)) * _U(parts) >> _U(31)).astype(np.int64)
        ends = np.searchsorted(at, np.arange(parts + 1))
        many = np.diff(ends)
        name = _mix((sums[ends[1:]] - sums[ends[:-1]]) ^ _mix(np.arange(parts, dtype=_U) + _U(k << 32)) + many.astype(_U))
        out.append(name[many > 0] if np.count_nonzero(many) > h else name)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def bitmap(names: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, np.uint8)
    out[(names & _U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def linked_sets(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


class Tree:
    """Levels of nodes over documents in an order that puts like ones together; the lowest level is the documents."""

    def __init__(self, members: list[tuple], width: int):
        """members: (uid, comp, size, code, bitmap); width: of all bitmaps, in bytes."""
        members = sorted(members, key=lambda m: (m[3], m[2], m[0]))
        self.uid = np.array([m[0] for m in members])
        self.comp = np.array([m[1] for m in members])
        bits = np.stack([fold(m[4], width) for m in members])
        size = np.array([m[2] for m in members])
        self.levels = [(bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, more = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))


def fold(bits: bytes, width: int) -> np.ndarray:
    """A bitmap at a smaller width (powers of two, in bytes): a hash's lower bits are its place there."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def survivors(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of documents (places in a and b) that may be linked, and how much they may share: the dual traversal. a may be b."""
    most = i = j = np.zeros(1, np.int64)
    for level in range(max(len(a.levels), len(b.levels)) - 1, -1, -1):
        x, y = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        if a is b:
            once = i <= j if level else i < j
            i, j = i[once], j[once]
        most = np.empty(len(i), np.int64)
        for at in range(0, len(i), 4096):
            p, q = i[at : at + 4096], j[at : at + 4096]
            most[at : at + 4096] = np.bitwise_count(x[0][p] & y[0][q]).sum(1, dtype=np.int64) + np.minimum(x[3][p], y[3][q])
        most = np.minimum(most, np.minimum(x[2][i], y[2][j]))
        may = ((100 + PERCENT) * most >= PERCENT * (x[1][i] + y[1][j])) & (100 * x[2][i] >= PERCENT * y[1][j]) & (100 * y[2][j] >= PERCENT * x[1][i])
        i, j, most = i[may], j[may], most[may]
        if level:
            i, j = children(i, a, j, b, level - 1)
    return i, j, most


def children(i: np.ndarray, a: Tree, j: np.ndarray, b: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children on that level; in a tree that is not so high, a node stays itself."""
    f, g = (FANOUT if level < len(t.levels) - 1 else 1 for t in (a, b))
    below = [len(t.levels[min(level, len(t.levels) - 1)][1]) for t in (a, b)]
    p = np.repeat(i * f, f * g) + np.tile(np.repeat(np.arange(f), g), len(i))
    q = np.repeat(j * g, f * g) + np.tile(np.arange(g), len(j) * f)
    there = (p < below[0]) & (q < below[1])
    return p[there], q[there]


def between(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of different components, the likeliest first."""
    i, j, most = survivors(a, b)
    apart = a.comp[i] != b.comp[j]
    i, j, most = i[apart], j[apart], most[apart]
    share = most / (a.levels[0][1][i] + b.levels[0][1][j])
    order = np.lexsort((b.uid[j], a.uid[i], -share))
    return i[order], j[order]


def forest(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs in order of likelihood those that make a spanning forest of the components."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = x = above.get(above[x], above[x])
        return x

    out = []
    for p, q, x, y in zip(a.uid[i].tolist(), b.uid[j].tolist(), a.comp[i].tolist(), b.comp[j].tolist(), strict=True):
        r, s = root(x), root(y)
        if r != s:
            above[r] = s
            out.append((p, q))
    return out


def found(a: Tree, b: Tree, whole: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of uids to look at, and whether that is all: the forest only, if it isn't, unless whole."""
    i, j = between(a, b)
    if whole or len(i) <= AT_ONCE * (len(a.uid) + len(b.uid)):
        return list(zip(a.uid[i].tolist(), b.uid[j].tolist(), strict=True)), True
    return forest(a, b, i, j), False


MEMBER = ["uid", "comp", "size", "code", "bits"]


def traversed(members: DataFrame, about: DataFrame, whole: bool, crossed: bool) -> DataFrame:
    """(a, b) of pairs to look at in the trees of members (key, uid, comp), cut into blocks, a < b, and (key, null) of trees that have more; crossed: blocks meet each other, too."""
    many = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").select("key", "parts")
    rows = durable(members.join(many, "key").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")))

    def blocks(rows: DataFrame) -> DataFrame:
        met = rows.join(about, "uid").repartition("key", "block")  # single rows, of which a set's equal bitmaps lie together, shuffle as a third of lists of them
        return met.groupBy("key", "parts", "block").agg(F.collect_list(F.struct(*MEMBER)).alias("held"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("size").alias("s0"), F.max("size").alias("s1"))

    own = blocks(rows).where("c0 <> c1")
    own = own.select("key", "held", F.lit(None).cast(own.schema["held"].dataType).alias("other"))
    several = rows.where("parts > 1")
    if crossed and not several.isEmpty():
        wide = durable(blocks(several))
        roots = wide.drop("held", "parts")
        left = roots.select("key", *(F.col(c).alias(f"{c}_l") for c in ("block", "c0", "c1", "s0", "s1")))
        met = left.join(roots, "key").where("block_l < block and not (c0 = c1 and c0_l = c1_l and c0 = c0_l)").where(f"100 * s1 >= {PERCENT} * s0_l and 100 * s1_l >= {PERCENT} * s0").select("key", "block_l", "block")
        two = met.join(wide.select("key", F.col("block").alias("block_l"), "held"), ["key", "block_l"]).join(wide.select("key", "block", F.col("held").alias("other")), ["key", "block"])
        own = own.unionByName(two.select("key", "held", "other"))

    def run(source):
        for key, held, other in source:
            sides = [[tuple(m[c] for c in MEMBER) for m in x] for x in (held, other) if x is not None]
            width = min(len(m[4]) for x in sides for m in x)
            made = [Tree(x, width) for x in sides]
            pairs, all_ = found(made[0], made[-1], whole)
            yield from ((min(p), max(p)) for p in pairs)
            if not all_:
                yield key, None

    return map_rows(own, run, "a bigint, b bigint").distinct()


def checked(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose whole sets are linked; held: (uid, text)."""
    rows = pairs.join(held.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")

    def run(source):
        s, last, of_last = Shingler(), None, None
        for a, b, text_a, text_b in source:
            if b != last:
                last, of_last = b, s(text_b)
            if linked_sets(s(text_a), of_last):
                yield a, b

    return map_rows(rows.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint")


def signatures(clean: DataFrame) -> DataFrame:
    """(text_key, text) -> a row for each distinct text of a task with its set's name and size, and what its trees need; a stored table."""

    def run(source):
        import xxhash

        s, known = Shingler(), set()
        for text_key, text in source:
            if text_key in known:
                continue
            if len(known) > MOST_TEXTS:
                known.clear()
            known.add(text_key)
            names = s(text)
            n = len(names)
            if n:
                kind = int(np.searchsorted(_LEAST, n, "right")) - 1
                yield text_key, xxhash.xxh3_128_digest(names.tobytes()), n, int(_mix(names).min()) >> 1, bitmap(names, bits_of(kind)), keys(names).tolist()

    found = map_rows(clean.select("text_key", "text"), run, "text_key binary, node binary, size bigint, code bigint, bits binary, keys array<bigint>")
    return durable(found.withColumn("uid", F.monotonically_increasing_id()))


def trees(signed: DataFrame, twins: DataFrame) -> DataFrame:
    """(key, uid, n) of all trees of n sets, two or more; of trees with the same sets one. twins: (uid) of sets that are there before, and so are in all their trees by the first of them."""
    rows = told(signed.select("uid", "keys"), "uid", twins)
    rows = rows.where("not _may").unionByName(rows.where("_may").join(twins, "uid", "left_anti"))
    each = rows.select(F.explode("keys").alias("key"), "uid")
    near = Window.partitionBy("key").orderBy("uid")
    shared = each.withColumn("_b", F.lag("uid").over(near)).withColumn("_a", F.lead("uid").over(near)).where("_b is not null or _a is not null").select("key", "uid")
    shared = durable(shared)
    prints = shared.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("uid").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("x"))
    one = prints.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n")
    return durable(shared.join(one, "key"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the least doc_id that links reach, its own included.

    Documents with the same set are linked; null and empty texts, and those without words, have none and are linked with nothing (also
    not with rows of the same doc_id). Null ids are never least; where a component has no other, component_id is null. Repeated rows have equal sets.
    """
    clean = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    signed = signatures(clean)
    first = signed.groupBy("node").agg(F.min("uid").alias("first"), F.count("*").alias("n"))
    named = durable(signed.select("text_key", "node", "uid", "size").join(first, "node").select("text_key", "uid", "first", "size", "n"))
    members = trees(signed, named.where("uid <> first").select("uid"))
    wanted = durable(members.select("uid").distinct())
    about = durable(likely(signed.select("uid", "size", "code", "bits", "text_key"), "uid", wanted).join(wanted, "uid", "left_semi"))
    need = about.select("text_key", "uid")
    # The sets' texts differ, so that each text is once in need.
    held = durable(likely(clean.select("text_key", "text"), "text_key", need.select("text_key")).dropDuplicates(["text_key"]).join(need, "text_key").select("uid", "text"))
    about = about.drop("text_key")
    links = about.where("false").select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    comps = about.where("false").select(F.col("uid").alias("node"), F.col("uid").alias("comp"))
    tried = links

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(comps.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))

    def turn(rows: DataFrame, whole: bool, crossed: bool) -> tuple[bool, DataFrame]:
        """Looks at pairs in the trees of rows (key, uid, comp). Whether it has found links, and the trees (key) that have more pairs."""
        nonlocal comps, tried
        told = durable(traversed(rows.select("key", "uid", "comp"), about, whole, crossed))
        pairs = told.where("b is not null").join(tried, ["a", "b"], "left_anti")
        good = durable(checked(pairs, held))
        tried = tried.unionByName(told.where("b is not null"))
        some = not good.isEmpty()
        if some:
            comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(good))
        return some, told.where("b is null").select(F.col("a").alias("key"))

    # First each set in its largest tree, a set a component.
    own = members.groupBy("uid").agg(F.max(F.struct("n", (-F.xxhash64("key")).alias("h"), "key")).alias("t")).select("uid", F.col("t.key").alias("key"))
    own = durable(own)
    while True:
        rows = durable(placed(own).groupBy("key", "comp").agg(F.min(F.struct(F.xxhash64("uid").alias("h"), "uid")).alias("m")).select("key", "comp", F.col("m.uid").alias("uid")))
        widest = rows.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if widest < 2 or not turn(rows, False, False)[0] or widest <= BLOCK:
            break  # what blocks of a tree have with each other is left to the turns below
    # Then all trees with more than one component, the likeliest pairs first; then those that have more.
    rows = placed(members.select("key", "uid").join(about.select("uid", "size"), "uid"))
    apart = f"c0 <> c1 and (n > 2 or 100 * s0 >= {PERCENT} * s1)"
    open_ = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("size").alias("s0"), F.max("size").alias("s1")).where(apart).select("key")
    rows = durable(rows.join(open_, "key", "left_semi").select("key", "uid", "comp"))
    _, more = turn(rows, False, True)
    if not more.isEmpty():
        turn(placed(rows.join(more.distinct(), "key", "left_semi").select("key", "uid")), True, True)

    ids = clean.select("doc_id", "text_key")
    least = ids.groupBy("text_key").agg(F.min("doc_id").alias("least"))
    of = named.groupBy("text_key").agg(F.min("first").alias("uid"), F.min("size").alias("size"))
    told = durable(placed(of.join(least, "text_key")).select("text_key", "size", "comp", "least"))
    final = told.join(told.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("text_key", "size", "component_id")
    out = ids.join(final, "text_key", "left")
    return out.select("doc_id", F.coalesce("size", F.lit(0).cast("bigint")).alias("n_shingles"), F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
