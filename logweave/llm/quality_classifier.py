"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each text or abstain; expectation maximisation over the corpus's vote patterns estimates
their accuracies (`weak_labels`); the posterior labels of a bounded sample train a hashed linear scorer, which then scores
every text. Gold labels are not used.

The scorer sees what labellers don't vote on as such: word shapes (THAT!! is `A!`), word ends and levels of the measures, hashed.
Every character counts: the shape is of the whole word, and a long shape goes in as its n-grams, which weigh together as one word.
"""

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import durable, map_rows, text_udf, text_key, texts
from logweave.llm.text_stats import Stats, measure
from logweave.llm.weak_labels import VoterModel, fit, parse, pattern_counts

#: Hash buckets, and the most texts that the scorer is fitted on (those with the least hash of their id).
BUCKETS, FIT_ROWS = 1 << 14, 6000
KEEP_AT = 0.5
#: Longer words are not remembered; longer shapes are cut into n-grams of GRAM characters.
LONG, GRAM = 64, 8
_RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[a-zß-öø-ÿ]+|[0-9]+|(.)\1*", re.S)


def labels(s: Stats) -> str:
    """One vote a labeller: '+', '-' or '0'."""
    n, chars = max(s.n_words, 1), max(s.n_chars, 1)

    def vote(good, bad):
        return "-" if bad else "+" if good else "0"

    return "".join(
        (
            vote(s.n_symbols * 30 < n, s.n_symbols * 3 > n),
            vote(s.n_symbols * 300 < chars, s.n_symbols * 25 > chars),
            vote(s.n_symbol_words * 30 < n, s.n_symbol_words * 3 > n),
            vote(s.n_shouted == 0, s.n_shouted * 10 > n),
            vote(s.n_upper * 20 < n, s.n_upper * 3 > n),
            vote(n >= 20 and s.n_repeat_words * 10 < n, n >= 20 and s.n_repeat_words * 10 > 7 * n),
            vote(n >= 20 and s.n_distinct * 5 > 2 * n, n >= 40 and s.n_distinct * 5 < n),
            vote(s.n_same_next * 20 < n, n >= 10 and s.n_same_next * 3 > n),
            vote(s.n_lines >= 2 and s.n_dup_lines == 0, s.n_lines >= 3 and s.n_dup_lines * 3 > s.n_lines),
        )
    )


LABELLERS = 9


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def shape(word: str) -> str:
    """Upper-case runs as A, lower-case as a, digits as 0, a run of anything else as its character."""
    return "".join("A" if m[0][0].isupper() else "a" if m[0][0].islower() else "0" if m[0][0].isdigit() else m[0][0] for m in _RUN.finditer(word))


def long_shape(word: str) -> dict[int, float]:
    """Buckets of a long word's shape, with weights that sum to 1."""
    s = shape(word)
    if len(s) <= LONG:
        return {bucket("shape:" + s): 1.0}
    n = len(s) - GRAM + 1
    out: dict[int, float] = {}
    for gram, c in Counter(s[i : i + GRAM] for i in range(n)).items():
        b = bucket("gram:" + gram)
        out[b] = out.get(b, 0.0) + c / n
    return out


class Shapes(dict):
    def __missing__(self, word: str) -> int:
        out = bucket("shape:" + shape(word))
        if len(self) > 300_000:
            self.clear()
        self[word] = out
        return out


def features(text: str | None, s: Stats, shapes: Shapes) -> dict[int, float]:
    n = max(s.n_words, 1)
    out: dict[int, float] = {}
    counts: dict[int, float] = {}
    for word in (text or "").split():
        if len(word) <= LONG:
            b = shapes[word]
            counts[b] = counts.get(b, 0) + 1
            continue
        for b, c in long_shape(word).items():
            counts[b] = counts.get(b, 0) + c
    for b, c in counts.items():
        out[b] = math.sqrt(c / n)
    for name, value in zip(Stats._fields, s, strict=True):
        level = 0 if not value else 1 + min(9, int(10 * value / n))
        if name in ("n_words", "word_chars", "n_chars"):
            level = min(9, int(math.log2(value + 1)))
        b = bucket(f"{name}:{level}")
        out[b] = out.get(b, 0.0) + 1.0
    return out


def prepared(docs: DataFrame) -> DataFrame:
    """One pass over whole texts: votes and hashed features."""

    def rows(source):
        shapes = Shapes()
        for doc_id, text in source:
            yield doc_id, text_key(text), *described(text, shapes)

    return map_rows(docs, rows, "doc_id bigint, text_key string, n_words bigint, votes string, buckets array<int>, weights array<float>")


def described(text: str | None, shapes: Shapes) -> tuple[int, str, list[int], list[float]]:
    s = measure(text)
    f = sorted(features(text, s, shapes).items())
    return s.n_words, labels(s), [k for k, _ in f], [v for _, v in f]


@dataclass(frozen=True)
class Scorer:
    weights: bytes  # float32, BUCKETS of them
    bias: float


def train(sample: list[tuple[list[int], list[float]]], target: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels, by Adam over the whole sample; classes weigh the same."""
    w, b = np.zeros(BUCKETS), 0.0
    if not sample:
        return Scorer(w.astype(np.float32).tobytes(), 2.0)
    row = np.repeat(np.arange(len(sample)), [len(f) for f, _ in sample])
    col = np.concatenate([np.array(f, int) for f, _ in sample])
    val = np.concatenate([np.array(v, float) for _, v in sample])
    good = min(max(target.mean(), 0.02), 0.98)
    weight = target * 0.5 / good + (1 - target) * 0.5 / (1 - good)
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for i in range(1, steps + 1):
        z = np.bincount(row, val * w[col], len(sample)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(sample)
        g = np.append(np.bincount(col, err[row] * val, BUCKETS) + decay * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Scorer(w.astype(np.float32).tobytes(), float(b))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, fit_rows: int = FIT_ROWS, with_key: bool = False) -> tuple[DataFrame, VoterModel, Scorer]:
    """(doc_id, n_words, votes, score, kept; text_key if asked for) for every row, and the fitted models.

    Null and empty texts score 0 and aren't kept; repeated rows score alike; other columns are not read. The labels' model counts every row;
    the scorer is fitted on at most `fit_rows` texts.
    """
    rows = durable(prepared(texts(docs, id_col, text_col)))
    model, scorer = fitted(rows, fit_rows)

    def score(source):
        w = np.frombuffer(scorer.weights, np.float32)
        for doc_id, key, n, votes, b, v in source:
            p = probability(w, scorer.bias, n, b, v)
            yield doc_id, key, n, votes, p, p >= keep_at

    out = map_rows(rows, score, "doc_id bigint, text_key string, n_words bigint, votes string, score double, kept boolean")
    return out if with_key else out.drop("text_key"), model, scorer


def fitted(rows: DataFrame, fit_rows: int) -> tuple[VoterModel, Scorer]:
    counts = pattern_counts(rows.where("n_words > 0"))
    model = fit(counts, LABELLERS)
    some = rows.where("n_words > 0").orderBy(F.xxhash64("doc_id"), "doc_id", "votes", "n_words").limit(fit_rows).select("votes", "buckets", "weights").collect()
    target = model.posterior(parse([r[0] for r in some])) if some else np.zeros(0)
    return model, train([(r[1], r[2]) for r in some], target)


def probability(w: np.ndarray, bias: float, n: int, b: list[int], v: list[float]) -> float:
    z = float(w[b] @ np.array(v, np.float32)) + bias if n else -50.0
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) if n else 0.0


def good_rows(docs: DataFrame, keep_at: float = KEEP_AT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs (with doc_id and text) that `classify` keeps, as they were. Rows are stored beside their features, so that they meet their verdict without a join."""

    shapes = Shapes()  # goes to each task empty, and stays for its batches

    def describe(some: list):
        for text in some:
            n, votes, b, v = described(text, shapes)
            yield {"n_words": n, "votes": votes, "buckets": b, "weights": v}

    found = text_udf(describe, "struct<n_words:bigint,votes:string,buckets:array<int>,weights:array<float>>")
    rows = durable(docs.select(F.struct("*").alias("row"), found(F.col("text")).alias("found")))
    _, scorer = fitted(rows.select(F.col("row.doc_id").alias("doc_id"), "found.*"), fit_rows)

    def verdicts(some: list):
        w = np.frombuffer(scorer.weights, np.float32)
        for x in some:
            yield probability(w, scorer.bias, x["n_words"], x["buckets"], x["weights"]) >= keep_at

    return rows.where(text_udf(verdicts, "boolean")(F.col("found"))).select("row.*")
