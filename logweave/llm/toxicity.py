"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled texts, as TF-IDF vectors over all terms of the sample; equal vectors are taken together.
Document frequencies are counted over all documents. A term's weight is also multiplied by how well it goes with the label, from 1/34
to 1 (relevance); no term is left out. A query's bound for a block of examples comes from the largest weights in it; only blocks
that can't hold a nearer example are passed over, so its nearest are exact. They vote with weights that fall with distance, and an
isotonic fit on labelled texts outside the index turns votes into calibrated scores. Every score comes with its evidence, the nearest
examples.
"""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import islice
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import map_rows, text_udf, text_key, texts

#: Bounds of what is fitted: labelled rows (those with the least hash of their id). Examples to a block, neighbours, queries at a time.
FIT_ROWS, BLOCK, NEAREST, QUERIES = 6_000, 64, 25, 64
#: Relevance is half at this many standard errors over the rate of toxic texts.
HALF_Z = 3.5
#: Terms in more than this share of examples are multiplied as a dense matrix, the others by their postings.
COMMON = 1 / 16
TOXIC_AT = 0.7
#: Texts whose result a Python worker remembers.
MOST_KNOWN = 100_000
words = re.compile(r"\w+").findall


def terms(text: str | None) -> list[str]:
    return words((text or "").lower())


class Packed(NamedTuple):
    """A vector: rising term numbers (int32) and their weights (float64)."""

    ids: bytes
    weights: bytes


Vector = Packed | tuple[tuple[int, float], ...]


def arrays(v: Vector) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(v, Packed):
        return np.frombuffer(v.ids, np.int32), np.frombuffer(v.weights, np.float64)
    return np.array([t for t, _ in v], np.int32), np.array([w for _, w in v], np.float64)


@dataclass
class Example:
    doc_id: int | None
    vector: Vector
    n: int
    toxic: int


class Index:
    """Block-max inverted index of unit vectors with weights over 0."""

    def __init__(self, examples: list[Example]):
        self.examples, n = examples, len(examples)
        self.vectors = [arrays(e.vector) for e in examples]
        ids = np.concatenate([i for i, _ in self.vectors] or [np.zeros(0, np.int32)])
        weights = np.concatenate([w for _, w in self.vectors] or [np.zeros(0)])
        row = np.repeat(np.arange(n, dtype=np.int32), [len(i) for i, _ in self.vectors])
        self.size = int(ids.max()) + 1 if len(ids) else 0
        common = np.flatnonzero(np.bincount(ids, minlength=self.size) > n * COMMON)
        self.place = np.full(self.size, -1, np.int32)
        self.place[common] = np.arange(len(common))
        self.starts = np.arange(0, n, BLOCK)
        self.dense = np.zeros((n, len(common)), np.float32)
        at = self.place[ids]
        self.dense[row[at >= 0], at[at >= 0]] = weights[at >= 0]
        self.most = np.maximum.reduceat(self.dense, self.starts, axis=0) if n else self.dense
        ids, weights, row = ids[at < 0], weights[at < 0], row[at < 0]
        order = np.argsort(ids, kind="stable")
        self.row, self.weights = row[order], weights[order]
        self.ends = np.searchsorted(ids[order], np.arange(self.size + 1))

    def nearest(self, query: Vector, k: int = NEAREST) -> list[tuple[float, int]]:
        """The k largest (cosine, -number), largest first; ties go to the lower number. Only cosines over 0."""
        return self.nearest_of([query], k)[0]

    def nearest_of(self, queries: list[Vector], k: int = NEAREST) -> list[list[tuple[float, int]]]:
        """`nearest` of each. Single precision only decides, with room for its error, which cosines are computed in full."""
        m, n = len(queries), len(self.examples)
        if not n:
            return [[] for _ in queries]
        known = []
        common, sums, room = np.zeros((m, self.dense.shape[1]), np.float32), np.zeros((m, n), np.float32), np.zeros(m)
        for r, (ids, w) in enumerate(map(arrays, queries)):
            ids, w = ids[ids < self.size], w[ids < self.size]
            known.append((ids, w))
            room[r] = (len(ids) + 8) * 2.0**-21
            at = self.place[ids]
            common[r, at[at >= 0]] = w[at >= 0]
            first, rare = self.ends[ids[at < 0]], w[at < 0]
            sizes = self.ends[ids[at < 0] + 1] - first
            each = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            sums[r] = np.bincount(self.row[each], self.weights[each] * np.repeat(rare, sizes), n)
        bounds = common @ self.most.T + np.maximum.reduceat(sums, self.starts, axis=1)
        seen, top = np.zeros((m, n), bool), np.zeros((m, k), np.float32)
        for b in np.argsort(-bounds.max(axis=0), kind="stable"):
            go = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] + room >= top.min(axis=1)))
            if not len(go):
                continue
            part = slice(b * BLOCK, min(n, (b + 1) * BLOCK))
            found = common[go] @ self.dense[part].T + sums[go, part]
            sums[go, part], seen[go, part] = found, True
            top[go] = np.partition(np.concatenate([top[go], found], axis=1), -k, axis=1)[:, -k:]
        least, out, mine = top.min(axis=1), [], np.zeros(self.size)
        for r, (ids, w) in enumerate(known):
            found = np.flatnonzero(seen[r] & (sums[r] > 0) & (sums[r] >= least[r] - room[r])).tolist()
            near = []
            if found:
                mine[ids] = w
                parts = [self.vectors[i] for i in found]
                ends = np.cumsum([len(t) for t, _ in parts])
                each = mine[np.concatenate([t for t, _ in parts])] * np.concatenate([v for _, v in parts])
                mine[ids] = 0.0
                cosines = np.add.reduceat(each, np.concatenate(([0], ends[:-1])))
                near = [(round(min(1.0, c), 12), -i) for c, i in zip(cosines.tolist(), found, strict=True)]
            out.append(sorted((x for x in near if x[0] > 0), reverse=True)[:k])
        return out


@dataclass
class Model:
    terms: dict[str, int]
    #: Of each term: idf times relevance.
    weights: np.ndarray
    examples: list[Example]
    base: float
    #: Calibration: rising (raw, score) steps.
    steps: list[tuple[float, float]]

    @cached_property
    def index(self) -> Index:
        """Only asked for on executors, so that it isn't sent with the model."""
        return Index(self.examples)

    def vector(self, text: str | None) -> Packed:
        get = self.terms.get
        n = Counter(map(get, terms(text)))
        n.pop(None, None)
        ids, counts = np.fromiter(n.keys(), np.int32, len(n)), np.fromiter(n.values(), np.float64, len(n))
        order = np.argsort(ids)
        ids = ids[order]
        v = (1 + np.log(counts[order])) * self.weights[ids]
        return Packed(ids.tobytes(), (v / math.sqrt(v @ v)).tobytes() if len(v) else b"")

    def raw(self, near: list[tuple[float, int]]) -> float:
        """Distance-weighted votes, with the base rate as one vote."""
        up, down = self.base, 1.0
        for c, i in near:
            e = self.examples[-i]
            w = c**4 * math.sqrt(e.n)
            up += w * e.toxic / e.n
            down += w
        return up / down

    def calibrated(self, raw: float) -> float:
        if not self.steps:
            return raw
        for (x0, y0), (x1, y1) in zip(self.steps, self.steps[1:], strict=False):
            if x0 <= raw < x1:
                return y0 + (y1 - y0) * (raw - x0) / (x1 - x0)
        return self.steps[0][1] if raw < self.steps[0][0] else self.steps[-1][1]


def isotonic(points: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """Rising means by pooling. A pool gives its smoothed mean label from its least raw to its largest; between pools scores run straight."""
    by: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for x, y in points:
        by[round(x, 3)][0] += y
        by[round(x, 3)][1] += 1
    pools: list[list[float]] = []  # sum of labels, count, least and largest raw
    for x in sorted(by):
        pools.append([*by[x], x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2], high]
    out: list[tuple[float, float]] = []
    for y, n, low, high in pools:
        value = max((y + 0.5) / (n + 1), out[-1][1] if out else 0.0)
        out += [(low, value), (high, value)] if high > low else [(low, value)]
    return out


def is_held_out(id: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def relevance(toxic: np.ndarray, other: np.ndarray, base: float) -> np.ndarray:
    """From 1/34 to 1, rising with the standard errors by which the term's toxic texts are over the rate; one text is added, so that rare terms count less."""
    n = toxic + other
    z = (toxic - n * base) / np.sqrt((n + 1) * base * (1 - base))
    return 1 / (1 + np.exp(HALF_Z - np.maximum(0.0, z)))


def several(items: Iterable, n: int) -> Iterable[list]:
    items = iter(items)
    while some := list(islice(items, n)):
        yield some


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """docs: (doc_id, text); labels: (doc_id, toxic), of which rows with a null are left out, and of repeated ids the largest label counts.

    Only the document frequencies of the sample's terms come from all documents; the rest is from at most `fit_rows` labelled ones.
    """
    spark = docs.sparkSession
    some = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # At most fit_rows pairs of numbers, so they may be broadcast.
    rows = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")

    def count(source):
        found: Counter = Counter()
        for text, toxic in source:
            found.update((t, toxic) for t in set(terms(text)))
            found[None, toxic] += 1
        for (t, toxic), n in found.items():
            yield t, n * toxic, n * (1 - toxic)

    # Copies count once, so that a large group of them doesn't make terms of its words.
    each = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    # Arrow columns, as a row object for each term would take much of the driver's memory.
    counts = map_rows(each, count, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).orderBy("term").toArrow()
    if not counts.num_rows:
        return Model({}, np.zeros(0), [], 0.05, [])
    # The null term comes first: it counts texts.
    toxic, other = counts["toxic"].to_numpy(), counts["other"].to_numpy()
    base = float((toxic[0] + 1) / (toxic[0] + other[0] + 2))
    numbers = {t: i for i, t in enumerate(counts["term"][1:].to_pylist())}
    of_terms = relevance(toxic[1:], other[1:], base)
    del counts
    known = spark.sparkContext.broadcast(numbers)

    def frequency(source):
        found, total, get = Counter(), 0, known.value.get
        for _, text in source:
            found.update(map(get, set(terms(text))))
            total += 1
        found.pop(None, None)
        yield -1, total
        yield from found.items()

    found = map_rows(docs.select("doc_id", "text"), frequency, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(numbers) + 1)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    model = Model(numbers, (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1) * of_terms, [], base, [])
    shared = spark.sparkContext.broadcast(model)

    def vectors(source):
        m = shared.value
        for doc_id, text, toxic in source:
            yield doc_id, *m.vector(text), toxic

    rows = map_rows(rows, vectors, "doc_id bigint, terms binary, weights binary, toxic int").collect()
    held, merged = [], {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["terms"], r["weights"])):
        v = Packed(bytes(r["terms"]), bytes(r["weights"]))
        if r["doc_id"] % 5 == 0:  # a fifth is for calibration
            held.append((v, r["toxic"]))
            continue
        e = merged.setdefault(v, Example(r["doc_id"], v, 0, 0))
        e.n += 1
        e.toxic += r["toxic"]
    none = merged.pop(Packed(b"", b""), Example(None, (), 0, 0))
    base = (none.toxic + 1) / (none.n + 1 / base)

    def heaviest(e: Example) -> int:
        ids, w = arrays(e.vector)
        return int(ids[w.argmax()])

    # Examples with the same heaviest term go to the same blocks, so that bounds part blocks well.
    model = Model(numbers, model.weights, sorted(merged.values(), key=lambda e: (heaviest(e), e.doc_id)), base, [])
    index = Index(model.examples)
    near = (x for v in several((v for v, _ in held), QUERIES) for x in index.nearest_of(v))
    model.steps = isotonic([(model.raw(x), y) for x, (_, y) in zip(near, held, strict=True)])
    return model


def score(docs: DataFrame, model: Model, toxic_at: float = TOXIC_AT) -> DataFrame:
    """(doc_id, text_key, score, predicted, evidence) for every row; docs: (doc_id, text).

    A text with no term of the sample (empty and null ones, too) gets the calibrated base rate. Equal texts have equal scores. evidence: up
    to five nearest examples (doc_id, cosine, share of toxic ones among texts with its vector).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(source):
        m, known = shared.value, {}
        for some in several(source, QUERIES):
            keys = found(m, known, [text for _, text in some])
            for key, (doc_id, _) in zip(keys, some, strict=True):
                p, near = known[key]
                yield doc_id, key, p, int(p >= toxic_at), [{"doc_id": a, "cosine": b, "toxic": c} for a, b, c in near]

    return map_rows(docs, rows, "doc_id bigint, text_key string, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,toxic:double>>")


def found(m: Model, known: dict, some: list) -> list[str]:
    """The texts' keys; adds to `known` what is found of those that are not there: (score, evidence)."""
    keys = [text_key(text) for text in some]
    if len(known) > MOST_KNOWN:
        known.clear()
    fresh = {key: text for key, text in zip(keys, some, strict=True) if key not in known}
    for key, near in zip(fresh, m.index.nearest_of([m.vector(text) for text in fresh.values()]), strict=True):
        known[key] = (m.calibrated(m.raw(near)), [(m.examples[-i].doc_id, c, m.examples[-i].toxic / m.examples[-i].n) for c, i in near[:5]])
    return keys


def clean_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, toxic_at: float = TOXIC_AT) -> DataFrame:
    """The rows of docs (with doc_id and text) that are not predicted toxic, as they were. One pass over the texts, no shuffle: rows wait in the JVM for their verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts(docs), labels, fit_rows))

    known: dict = {}  # goes to each task empty, and stays for its batches

    def verdicts(some: list):
        for part in several(some, QUERIES):
            for key in found(shared.value, known, part):
                yield int(known[key][0] >= toxic_at)

    return docs.where(text_udf(verdicts, "int")(F.col("text")) == 0)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, with_key: bool = False) -> DataFrame:
    """Fits on the labelled documents and scores all: (doc_id, held_out, score, predicted, evidence; text_key if asked for). Other columns are not read."""
    clean = texts(docs, id_col, text_col)
    out = score(clean, fit(clean, labels, fit_rows))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", *["text_key"] * with_key)
