"""Near-duplicate classes: improved consistent weighted sampling of TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five words in a row; its weight is its count in the text times a factor 1 + DAMP * idf / log(documents), where its idf is
the mean of its words' (document frequencies are counted over all documents, by hash of the word). DAMP is small, so that
the shared shingles of a large group of copies keep almost the weight of rare ones. Improved consistent weighted sampling draws
BANDS * ROWS shingles of each text so that two texts draw the same with a chance of their weighted Jaccard similarity; equal
bands make candidates, and each candidate is verified on whole texts.

Of a bucket (the texts that share a band) no pairs are emitted at large. A central text leads it and is compared with the others; what
proves similar is joined into components. In a second such round buckets that still hold more than one component have two leaders, of
their two largest components. Then the texts outside a bucket's largest component meet all texts of other components, so no link
between components is lost. All comparisons pass two exact bounds first, which texts that can't be similar don't: what two texts share
must be similar / (1 + similar) of their total weights, and a text shares neither its own shingles, those in no other candidate
text, nor those whose bit in a bitmap of shingle hashes is not set for the other (each weighs 1 at least).
"""

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import durable, map_rows, texts

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
DAMP, DF_BUCKETS = 0.25, 1 << 16
#: 64-bit words of a text's bitmap of shingle hashes.
SIGNS = 16
#: Words and texts whose results a Python worker remembers.
MOST_WORDS, MOST_TEXTS = 300_000, 20_000
#: Shingles of texts that are signed together: of short texts most time would go into calls of numpy.
TOGETHER = 20_000
words = re.compile(r"\w+").findall
_U = np.uint64


def terms(text: str | None) -> list[str]:
    return words((text or "").lower())


_S30, _S27, _S31, _M1, _M2 = (np.array(x, _U) for x in (30, 27, 31, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    y = np.right_shift(x, _S30)
    y ^= x
    y *= _M1
    y ^= y >> _S27
    y *= _M2
    y ^= y >> _S31
    return y


def word_hash(word: str | bytes) -> int:
    """64 bits, alike in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))


def hashes(some: list[str]) -> np.ndarray:
    """word_hash of each."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, map(str.encode, some, repeat("utf-8"), repeat("surrogatepass"))), _U, len(some))


def factors(df: np.ndarray, total: int) -> np.ndarray:
    """Per word bucket: DAMP * idf / log(total), from 0 to DAMP."""
    if total < 2:
        return np.zeros(len(df))
    return DAMP * np.log(total / np.clip(df, 1, total)) / math.log(total)


class Shingler:
    """Weighted shingles of a text: sorted 64-bit names and weights."""

    def __init__(self, factor: np.ndarray):
        self.factor = factor
        self._forget()

    def _forget(self) -> None:
        """Known words have numbers, by which their hashes and factors are taken."""
        self.known: dict[str, int] = {}
        self.hashes, self.factors = np.zeros(1024, _U), np.zeros(1024)

    def _learn(self, new: list[str]) -> None:
        at, n = len(self.known), len(self.known) + len(new)
        if n > len(self.hashes):
            self.hashes, self.factors = np.resize(self.hashes, 2 * n), np.resize(self.factors, 2 * n)
        self.known.update(zip(new, range(at, n), strict=True))
        self.hashes[at:n] = hashes(new)
        self.factors[at:n] = self.factor[self.hashes[at:n] % _U(DF_BUCKETS)]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        ws = terms(text)
        if not ws:
            return np.zeros(0, _U), np.zeros(0)
        if len(self.known) > MOST_WORDS:
            self._forget()
        at = np.fromiter(map(self.known.get, ws, repeat(-1)), np.int64, len(ws))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [ws[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            at[missing] = list(map(self.known.__getitem__, new))
        h, f = self.hashes[at], self.factors[at]
        k = min(SHINGLE, len(ws))  # a shorter text is one shingle
        n = len(ws) - k + 1
        name, weight = np.zeros(n, _U), np.zeros(n)
        for i in range(k):
            name = _mix(name + h[i : i + n] + _U(i + 1))
            weight += f[i : i + n]
        order = np.argsort(name)  # equal names have equal weights, so their order doesn't matter
        names, weights = name[order], 1 + weight[order] / k
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        if len(first) == n:
            return names, weights
        return names[first], np.diff(first, append=n) * weights[first]


#: The weight of a whole piece, and how many times the mean of a draw's least quantity is looked at first.
_PIECE, _MARGIN = 1 + DAMP, 7


def _exponential(bits: np.ndarray) -> np.ndarray:
    """Of the exponential distribution, by the upper 44 bits."""
    return -np.log(((bits >> _U(20)) + 0.5) * 2.0**-44)


def samples(names: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The drawn (shingle, level) of each of BANDS * ROWS draws, as 64-bit names.

    Improved consistent weighted sampling: for each shingle and draw there are levels y < z = y * exp(r) about the weight, log(z / weight) and
    log(weight / y) of the exponential distribution (so r is of Gamma(2, 1)), and c of Gamma(2, 1); the least a = c / z is drawn.
    a is of the exponential distribution of rate weight, and falls as the weight rises.

    So a shingle's weight is dealt into pieces of _PIECE and a rest, each sampled as a shingle of its own (the sum of minima stays), and of
    a piece its a for the weight _PIECE are made first, as first arrivals of all draws in one Poisson process, no further than a limit
    that a draw's least a hardly passes. Given a, c and z have the law of z = _PIECE + e / a, e exponential, c = a * z. Each is then carried
    to the piece's weight along its levels, where a can only be larger. If a draw's least does pass the limit, the limit is raised.
    """
    return samples_of([(names, weights)])[0]


def samples_of(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of samples for each of some sets, none of which is empty; sets are worked on together."""
    n, sizes = BANDS * ROWS, [len(x) for x, _ in sets]
    names, weights, of = np.concatenate([x for x, _ in sets]), np.concatenate([w for _, w in sets]), np.repeat(np.arange(len(sets)), sizes)
    limit = _MARGIN / np.add.reduceat(weights, np.cumsum([0, *sizes[:-1]]))
    if weights.max() > _PIECE:
        pieces = np.maximum(1, np.ceil(weights / _PIECE)).astype(np.int64)
        at = np.repeat(np.arange(len(names)), pieces)
        k = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        names, weights, of = np.where(k, _mix(names[at] + k.astype(_U) * _U(0xA0761D6478BD642F)), names[at]), np.minimum(weights[at] - k * _PIECE, _PIECE), of[at]
    seeds = _mix(names ^ _U(0xE7037ED1A0B428DB))
    first = _exponential(seeds) / (n * _PIECE)
    out, left = np.zeros((len(sets), n), _U), np.ones(len(sets), bool)
    while left.any():
        piece = np.flatnonzero((first <= limit[of]) & left[of])
        if len(piece):
            drawn, sure = _arrived(names, weights, of, seeds, first, piece, limit)
            out[sure], left[sure] = drawn[sure], False
        limit *= 2
    return out


def _arrived(names: np.ndarray, weights: np.ndarray, of: np.ndarray, seeds: np.ndarray, first: np.ndarray, piece: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is drawn of each set, and whether each of its draws has an a within its limit."""
    n = BANDS * ROWS
    row, bits, when = [], [], []
    # Arrivals of a piece are made some at a time, while they come within the limit.
    own, last, done, many = np.arange(len(piece)), first[piece][:, None], 0, 3
    while len(own):
        made = _mix(seeds[piece[own], None] + np.arange(done + 1, done + many + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        at = _exponential(made) / (n * _PIECE)
        if done:
            at = np.cumsum(np.concatenate((last, at), 1), 1)[:, 1:]
        else:
            at[:, :1] = last
            np.cumsum(at, 1, out=at)
        bound = limit[of[piece[own]]]
        r, c = np.nonzero(at <= bound[:, None])
        row.append(own[r])
        bits.append(made[r, c])
        when.append(at[r, c])
        more = np.flatnonzero(at[:, -1] <= bound)
        own, last, done, many = own[more], at[more, -1:], done + many, 2 * many
    row, bits, when = np.concatenate(row), np.concatenate(bits), np.concatenate(when)
    draw = ((bits & _U(0xFFFFF)).astype(np.int64) * n >> 20) + of[piece[row]] * n
    # By set, draw, piece and time (later ones of a piece are further on); of a piece and draw only the first arrival counts.
    low, middle = len(row).bit_length(), len(piece).bit_length()
    order = np.sort((draw << middle | row) << low | np.arange(len(row)))
    group = order >> low
    at = order[np.concatenate(([True], group[1:] != group[:-1]))] & (1 << low) - 1
    draw, a, at = draw[at], when[at], piece[row[at]]
    more = _mix(seeds[at] ^ (draw % n + 1).astype(_U) * _U(0x8EBC6AF09C88C6E3))
    log_z = np.log(_PIECE + _exponential(_mix(more)) / a)
    log_y = math.log(_PIECE) - _exponential(more)
    r = log_z - log_y
    level = np.floor((np.log(weights[at]) - log_y) / r)
    a = a * np.exp(log_z - log_y - (level + 1) * r)
    begins = np.flatnonzero(np.concatenate(([True], draw[1:] != draw[:-1])))
    least = np.minimum.reduceat(a, begins)
    is_least = np.flatnonzero(a == np.repeat(least, np.diff(begins, append=len(draw))))
    own = draw[is_least]
    is_least = is_least[np.concatenate(([True], own[1:] != own[:-1]))]
    there = draw[begins]
    within = np.zeros(len(limit) * n, bool)
    within[there] = least <= limit[there // n]
    drawn = np.zeros(len(limit) * n, _U)
    drawn[there] = _mix(names[at[is_least]] + level[is_least].astype(np.int64).astype(_U) * _U(0xD6E8FEB86659FD93))
    return drawn.reshape(-1, n), within.reshape(-1, n).all(1)


def bitmap(names: np.ndarray) -> list[int]:
    """SIGNS words with a bit for each hash of a shingle."""
    bits = np.zeros(64 * SIGNS, np.uint8)
    bits[(names % _U(64 * SIGNS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def bands(drawn: np.ndarray) -> np.ndarray:
    """Of a set's samples, or of a row of them for each set."""
    rows = drawn.reshape(*drawn.shape[:-1], BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key + rows[..., i])
    return key.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima by sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - both
    return float(both / whole) if whole else 1.0


def word_factors(docs: DataFrame) -> np.ndarray:
    """Document frequencies of all words in DF_BUCKETS sums; what reaches the driver has that size."""

    def rows(source):
        n, total = Counter(), 0
        for (text,) in source:
            n.update(set(terms(text)))
            total += 1
        sums = np.zeros(DF_BUCKETS, np.int64)
        np.add.at(sums, (hashes(list(n)) % _U(DF_BUCKETS)).astype(np.int64), np.fromiter(n.values(), np.int64, len(n)))
        at = np.flatnonzero(sums)
        yield -1, total
        yield from zip(at.tolist(), sums[at].tolist(), strict=True)

    df, total = np.zeros(DF_BUCKETS), 0
    for r in map_rows(docs.select("text"), rows, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return factors(df, total)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of (a, b) links: alternating large and small stars until nothing changes; comp is the least node.

    Each step is a grouped minimum and a join, so a node with very many links is split like any skewed join.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = durable(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now


def own_weights(held: DataFrame, factor) -> DataFrame:
    """(node, own) of (node, text) rows: the weight of the shingles that no other text has; texts without such are left out.

    Shingles are counted with partial sums before the shuffle; a node goes along as two numbers.
    """

    def rows(source):
        s = Shingler(factor.value)
        for node, text in source:
            names, weights = s(text)
            hi, lo = (int.from_bytes(node[i : i + 8], "big", signed=True) for i in (0, 8))
            yield hi, lo, names.view(np.int64).tolist(), weights.tolist()

    found = map_rows(held.select("node", "text"), rows, "hi bigint, lo bigint, names array<bigint>, weights array<double>")
    each = found.select("hi", "lo", F.inline(F.arrays_zip("names", "weights")))
    alone = each.groupBy("names").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("hi", "lo", "weights"))).where("n = 1")
    node = F.unhex(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0")))
    return alone.groupBy("hi", "lo").agg(F.sum("weights").alias("own")).select(node.alias("node"), "own")


#: What bounds and choices of leaders need of a text.
ABOUT = ["node", "weight", "own", "signs"]


def may_be_similar(similar: float) -> F.Column:
    """Whether a text (ABOUT) and a leading one (the same with `_led`) can be as similar as that, by exact bounds of what they share."""

    def shared(a: str, b: str) -> F.Column:
        missing = sum((F.bit_count(F.col(f"signs{a}")[i].bitwiseAND(F.bitwise_not(F.col(f"signs{b}")[i]))) for i in range(SIGNS)), F.lit(0))
        return F.col(f"weight{a}") - F.greatest(F.col(f"own{a}"), missing.cast("double"))

    needed = similar / (1 + similar) * (F.col("weight") + F.col("weight_led"))
    # The cheap bound comes first.
    return (F.least(F.col("weight") - F.col("own"), F.col("weight_led") - F.col("own_led")) * (1 + 1e-9) >= needed) & (F.least(shared("", "_led"), shared("_led", "")) * (1 + 1e-9) >= needed)


def verified(pairs: DataFrame, by_node: DataFrame, factor, similar: float) -> DataFrame:
    """The pairs (a, b) that are as similar as that; by_node: (node, text). Both whole texts meet in one row."""
    rows = pairs.join(by_node.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(by_node.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def check(source):
        s, last, of_last = Shingler(factor.value), None, None
        for a, b, text_a, text_b in source:
            if text_b != last:  # rows of a leader come together
                last, of_last = text_b, s(text_b)
            if jaccard(s(text_a), of_last) >= similar:
                yield a, b

    return map_rows(rows.select("a", "b", "text_a", "text_b"), check, "a binary, b binary")


def linked(members: DataFrame, held: DataFrame, factor, similar: float) -> DataFrame:
    """(node, comp) of all texts that have a link. members: (key, ABOUT), a row for each text and bucket."""
    possible = may_be_similar(similar)
    led_by = lambda c: F.struct(*(c[x].alias(x) for x in ABOUT))
    as_led = [F.col(f"led.{x}").alias(f"{x}_led") for x in ABOUT]
    order = F.struct((F.col("own") / F.col("weight")).alias("share"), F.xxhash64("node").alias("order"), *ABOUT)
    pair = [F.greatest("node", "node_led").alias("a"), F.least("node", "node_led").alias("b")]
    # First round: a bucket's leader is the text with the least share of own shingles, the middle of a group of near copies.
    first = members.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("led")).where("n > 1").select("key", *as_led)
    tried = durable(members.join(first, "key").where((F.col("node") != F.col("node_led")) & possible).select(*pair).distinct())
    comps = components(durable(verified(tried, held, factor, similar)))

    def still_open(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of buckets with more than one component, with the largest one's name; and the components of such buckets."""
        placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min(order).alias("best"))
        most = sizes.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("size", "comp")).alias("top")).where("n > 1").select("key", F.col("top.comp").alias("top"))
        return durable(placed.join(most, "key")), sizes.join(most, "key")

    # Second round: leaders of the two largest components.
    open_, sizes = still_open(members)
    others = sizes.where("comp <> top").groupBy("key").agg(F.max(F.struct("size", "comp", "best")).alias("x"))
    lead = others.select("key", F.col("x.comp").alias("comp_led"), led_by(F.col("x.best")).alias("led")).unionByName(sizes.where("comp = top").select("key", F.col("comp").alias("comp_led"), led_by(F.col("best")).alias("led")))
    lead = durable(lead.select("key", "comp_led", *as_led))
    pairs = open_.join(lead, "key").where((F.col("comp") != F.col("comp_led")) & possible).select(*pair).distinct()
    pairs = durable(pairs.join(tried, ["a", "b"], "left_anti"))
    comps = _joined(comps, pairs, held, factor, similar)
    tried = tried.unionByName(pairs)
    # Last: all texts outside a bucket's largest component meet the texts of other components.
    open_, _ = still_open(open_.select("key", *ABOUT))
    lone = open_.where("comp <> top").select("key", F.col("comp").alias("comp_led"), *(F.col(x).alias(f"{x}_led") for x in ABOUT))
    once = (F.col("comp") == F.col("top")) | (F.col("node") < F.col("node_led"))
    pairs = open_.join(lone, "key").where((F.col("comp") != F.col("comp_led")) & once & possible).select(*pair).distinct()
    pairs = durable(pairs.join(tried, ["a", "b"], "left_anti"))
    return _joined(comps, pairs, held, factor, similar)


def _joined(comps: DataFrame, pairs: DataFrame, held: DataFrame, factor, similar: float) -> DataFrame:
    """Components with those of more pairs that prove similar."""
    if pairs.isEmpty():
        return comps
    links = durable(verified(pairs, held, factor, similar))
    if links.isEmpty():
        return comps
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, text_key, class_id, first): class_id is the least doc_id of the class; first is true for one row id of each class.

    Equal texts are one class (empty and null texts together); so are texts linked by a chain of pairs that share a band
    and whose weighted Jaccard similarity is at least `similar`. Repeated rows are members like others. Null ids come last.
    """
    spark = docs.sparkSession
    clean = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    shared = spark.sparkContext.broadcast(word_factors(clean))

    def sign(source):
        s, known = Shingler(shared.value), set()
        nodes, sets, held = [], [], 0

        def signed():
            if sets:
                for node, (names, weights), keys in zip(nodes, sets, bands(samples_of(sets)).tolist(), strict=True):
                    yield node, float(weights.sum()), bitmap(names), keys

        for node, text in source:
            if node in known:  # copies are signed once a task
                continue
            if len(known) > MOST_TEXTS:
                known.clear()
            known.add(node)
            names, weights = s(text)
            if len(names):
                nodes.append(node)
                sets.append((names, weights))
                held += len(names)
            if held > TOGETHER:
                yield from signed()
                nodes, sets, held = [], [], 0
        yield from signed()

    signed = map_rows(clean.select("node", "text"), sign, "node binary, weight double, signs array<bigint>, bands array<bigint>")
    signed = durable(signed.dropDuplicates(["node"]))
    keys = signed.select("node", F.explode("bands").alias("key"))
    often = signed.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = durable(keys.join(often, "key", "left_semi"))
    # One row for each text that is in a shared bucket: the only texts that are read again.
    by_node = clean.select("node", "text", "doc_id")
    one = by_node.groupBy("node").agg(F.min("doc_id").alias("_least")).join(members.select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "_node")
    held = durable(by_node.join(one, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi").select("node", "text").dropDuplicates(["node"]))
    about = signed.select("node", "weight", "signs").join(own_weights(held, shared), "node", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    about = about.where((F.col("weight") - F.col("own")) * (1 + 1e-9) >= similar * F.col("weight"))
    comps = linked(durable(members.join(about, "node").select("key", *ABOUT)), held, shared, similar)
    rows = clean.select("doc_id", "node")
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    firsts = durable(firsts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    ids = firsts.groupBy("comp").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("pick"))
    told = firsts.join(ids, "comp").select("node", "class_id", (F.col("node") == F.col("pick.node")).alias("_own"), "least")
    out = rows.join(told, "node", "left")
    return out.select("doc_id", F.hex("node").alias("text_key"), "class_id", (F.col("_own") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("first"))


def keep_first(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs without all but one row of each class; columns as they were. Of repeated rows (same id and text) one stays."""
    kept = classes(docs, similar=similar).where("first").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = F.upper(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = docs.withColumn("_key_of", key)
    joined = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_key_of") == F.col("_key")), "left_semi")
    return joined.dropDuplicates(["doc_id", "_key_of"]).select(*docs.columns)
