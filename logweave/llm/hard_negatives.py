"""Hard negatives by a Voronoi-partition distributed join: vectors with most inner product are nearest neighbours once norms are evened out.

With M the greatest norm, a row x becomes x' = (x, sqrt(M^2 - |x|^2)) and an anchor q becomes q' = (q, 0), so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x falls as the inner product rises. PIVOTS rows span Voronoi cells; anchors of a cell form groups of at most
about ANCHORS. By the triangle inequality a row can serve a group with pivot p and radius U = max |q' - p| at most |p - x'| + U away and no nearer than
|p - x'| - U, and only to groups where that range meets the distances asked for it is replicated; there blocks of rows and anchors are joined
exactly, and what the blocks found is merged.

Two such joins are made: of each anchor with its own label (the bound: U and the distance of the (k+1)-th nearest row of the label to the pivot), which
gives the positives, then with other labels (the bounds: the least and greatest negative score that the group's positives allow).

Rows with equal label and vector are one entry with its least ids, as no answer can hold more of them; equal anchors are asked once. So a vector
that a third of all rows share costs a row.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import durable, map_rows

POSITIVES, NEGATIVES = 5, 5
PIVOTS = 16
#: Anchors to a group, and rows of a group that are joined in one task: the sizes of a block, not bounds of what is compared.
ANCHORS, BLOCK = 2048, 16_384
#: Anchors whose scores with a block are there at once.
TILE = 128
#: Up to here sums of products of doubles are exact.
EXACT = 2.0**53


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vec): components floor(256 * x), labels of ids that 7 divides moved on by one (modulo 10).

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Inner products must fit 63 bits, or the query fails.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    moved = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))
    used = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    return used.select(F.col(id_col).cast("bigint").alias("vec_id"), moved.cast("bigint").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("bigint")).alias("vec"))


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """(label, vec, ids): rows with equal label and vector, with their `keep` least ids. Spark prunes to these before it shuffles."""
    same = Window.partitionBy("label", F.xxhash64("vec"), "vec").orderBy("vec_id")
    return rows.withColumn("_place", F.dense_rank().over(same)).where(F.col("_place") <= keep).groupBy("label", "vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def matrix(vectors, size: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros (a component that only one has adds nothing to an inner product)."""
    size = max(map(len, vectors), default=0) if size is None else size
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scores(a, b) -> np.ndarray:
    """Exact inner products of two lists of integer vectors."""
    size = max(max(map(len, a), default=0), max(map(len, b), default=0))
    x, y = matrix(a, size), matrix(b, size)
    if size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * size < EXACT:
        return (x @ y.T).astype(np.int64)
    wide = [[sum(int(i) * int(j) for i, j in zip(v, w, strict=False)) for w in b] for v in a]
    return np.array(wide, np.int64)  # an OverflowError beyond 63 bits


def distances(vectors, pivots: np.ndarray, top: float, anchors: bool) -> np.ndarray:
    """From the augmented rows (anchors: with a last component of 0) to each augmented pivot."""
    x = matrix(vectors, pivots.shape[1] - 1)
    last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0, top - (x * x).sum(1)))
    whole = np.column_stack((x, last))
    return np.sqrt(np.maximum(0, (whole * whole).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * whole @ pivots.T))


def _assigned(rows: DataFrame, pivots: np.ndarray, top: float, anchors: bool, extra: list[tuple[str, str]]) -> DataFrame:
    """Adds `dist`, the distance to every pivot; the cell is that of the least."""

    def f(source):
        held = []
        for r in source:
            held.append(r)
            if len(held) == 2048:
                yield from done(held)
                held = []
        yield from done(held)

    def done(held):
        if held:
            far = distances([r[0] for r in held], pivots, top, anchors)
            for r, d in zip(held, far.tolist(), strict=True):
                yield (*r, d)

    schema = ", ".join(["vec array<bigint>", *(f"{n} {t}" for n, t in extra), "dist array<double>"])
    return map_rows(rows.select("vec", *(n for n, _ in extra)), f, schema)


def _blocks(found: DataFrame, asked: DataFrame, joined, out: str) -> DataFrame:
    """Joins blocks: found (grp, block, ...) with asked (grp, block, ...) of the same block; joined(asked, found) -> rows."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = joined(a, b) if len(a) and len(b) else []
        return pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in out.split(", ")]
    return asked.groupBy("grp", "block").cogroup(found.groupBy("grp", "block")).applyInPandas(run, out)


def _best(ids: list, values: np.ndarray, at: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) of the entries `at`: higher scores first, ties by id; an entry stands for its ids, and has the score of its own."""
    if len(at) > k:  # an entry has an id at least, so only those as good as the k-th count
        at = at[values[at] >= np.partition(values[at], len(at) - k)[len(at) - k]]
    return sorted((-int(values[i]), int(x)) for i in at.tolist() for x in ids[i])[:k]


def _of_own_label(k: int):
    def joined(a: pd.DataFrame, b: pd.DataFrame):
        labels, ids = b["label"].to_numpy(), b["ids"].tolist()
        for label, part in a.groupby("label"):
            mine = np.flatnonzero(labels == label)
            of = b["vec"].iloc[mine].tolist()
            own = [ids[i] for i in mine.tolist()]
            for lo in range(0, len(part) if len(mine) else 0, TILE):
                tile = part.iloc[lo : lo + TILE]
                for asked, row in zip(tile["asked"], scores(tile["vec"].tolist(), of), strict=True):
                    for s, x in _best(own, row, np.arange(len(row)), k):
                        yield asked, x, -s

    return lambda a, b: list(joined(a, b))


def _of_other_labels(k: int):
    def joined(a: pd.DataFrame, b: pd.DataFrame):
        labels, ids, of = b["label"].to_numpy(), b["ids"].tolist(), b["vec"].tolist()
        for lo in range(0, len(a), TILE):
            tile = a.iloc[lo : lo + TILE]
            for asked, label, wanted, row in zip(tile["asked"], tile["label"], tile["wanted"], scores(tile["vec"].tolist(), of), strict=True):
                near = np.flatnonzero((labels != label) & (row >= least_negative(min(wanted))) & (row <= max(wanted)))
                for score in wanted:
                    fit = near[(row[near] >= least_negative(score)) & (row[near] <= score)]
                    for s, x in _best(ids, row, fit, k):
                        yield asked, int(score), x, -s

    return lambda a, b: list(joined(a, b))


def least_negative(score: int) -> int:
    """The least s with 80 * score <= 100 * s."""
    return -(-80 * int(score) // 100)


def mined(rows: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `prepared` rows.

    A row's score is its inner product with the anchor; higher first, ties by id. Anchors' positives are their first other rows (another id) of the same label; negatives
    are the first of another label with 80 % of the positive's score at least and its score at most. Repeated rows count once; rows of one id that differ
    are rows of their own. Anchors without positives, or positives without negatives, give no row, nor does an empty table.
    """
    keep = positives + 1
    held = durable(entries(rows, keep))
    bounds = held.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("top"), F.count("*").alias("n"), F.max(F.size("vec")).alias("size")).first()
    top, blocks = bounds["top"] or 0.0, max(1, -(-(bounds["n"] or 0) // BLOCK))
    # PIVOTS rows reach the driver, chosen by hash.
    picked = [r["vec"] for r in held.orderBy(F.xxhash64("vec"), "vec", "label").limit(pivots).select("vec").collect()] or [[]]
    at = matrix(picked, bounds["size"] or 0)
    at = np.column_stack((at, np.sqrt(np.maximum(0, top - (at * at).sum(1)))))
    slack = 1e-6 * (1 + top**0.5)  # for rounding of distances

    anchors = rows.where(anchor).select("vec_id", "label", "vec")
    asked = anchors.select("label", "vec").distinct().withColumn("asked", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform("vec", lambda c: c.cast("string")), ",")).cast("binary")))
    asked = _assigned(asked, at, top, True, [("label", "bigint"), ("asked", "string")])
    cell = F.array_position("dist", F.array_min("dist")).cast("int") - 1
    asked = asked.withColumn("cell", cell).withColumn("_h", F.pmod(F.xxhash64("asked"), F.lit(1 << 30)))
    many = asked.groupBy("cell").agg(F.ceil(F.count("*") / ANCHORS).alias("_parts"))  # a row a cell
    asked = asked.join(F.broadcast(many), "cell").withColumn("grp", F.format_string("%d-%d", "cell", F.col("_h") % F.col("_parts")))
    asked = durable(asked.select("asked", "label", "vec", "cell", "grp", F.col("dist")[F.col("cell")].alias("away")))

    rest = durable(_assigned(held, at, top, False, [("label", "bigint"), ("ids", "array<bigint>")]).withColumn("block", F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int")))

    def served(want: DataFrame, near: str, far: str, on: list[str]) -> DataFrame:
        """Rows of each group that they may serve: those whose distance to its pivot is from near to far."""
        d = F.col("dist")[F.col("cell")]
        both = rest.join(want, on) if on else rest.join(F.broadcast(want))
        return both.where((d >= F.col(near) - slack) & (d <= F.col(far) + slack))

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    # Positives: the (k+1)-th nearest row of a label to the pivot bounds how far its groups have to look.
    radius = asked.groupBy("grp", "cell", "label").agg(F.max("away").alias("radius"))
    close = rest.select("label", F.posexplode("dist").alias("cell", "d"))
    place = F.row_number().over(Window.partitionBy("label", "cell").orderBy("d"))
    limit = close.withColumn("_place", place).where(F.col("_place") <= keep).groupBy("label", "cell").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    want = radius.join(limit, ["label", "cell"]).select("grp", "cell", "label", F.lit(0.0).alias("near"), F.when(F.col("n") < keep, F.lit(float("inf"))).otherwise(F.col("d") + 2 * F.col("radius")).alias("far"))
    found = served(want, "near", "far", ["label"]).select(*(F.col(c).alias(c) for c in ("grp", "block", "label", "vec", "ids")))
    first = _blocks(found, asked.select("grp", every, "asked", "label", "vec"), _of_own_label(keep), "asked string, id bigint, score bigint")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    best = first.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= keep)
    best = durable(best.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best")))

    # Negatives: scores from 80 % of the least positive score to the greatest are a ring about each anchor.
    scored = F.array_distinct(F.transform("best", lambda b: -b["s"]))
    asked2 = asked.join(best, "asked").withColumn("wanted", F.filter(scored, lambda s: s >= 0))  # under 0 no score is between
    asked2 = durable(asked2.where(F.size("wanted") > 0).drop("best"))
    own = F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) + top
    reach = lambda s: F.sqrt(F.greatest(F.lit(0.0), own - 2 * s))
    ring = asked2.groupBy("grp", "cell").agg(F.max(reach(F.ceil(F.array_min("wanted") * 0.8 - 1e-3)) + F.col("away")).alias("far"), F.min(reach(F.array_max("wanted")) - F.col("away")).alias("near"))
    found = served(ring, "near", "far", []).select(*(F.col(c).alias(c) for c in ("grp", "block", "label", "vec", "ids")))
    second = _blocks(found, asked2.select("grp", every, "asked", "label", "vec", "wanted"), _of_other_labels(negatives), "asked string, positive_score bigint, id bigint, negative_score bigint")
    order = Window.partitionBy("asked", "positive_score").orderBy(F.desc("negative_score"), "id")
    second = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

    key = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform("vec", lambda c: c.cast("string")), ",")).cast("binary"))
    named = anchors.select(F.col("vec_id").alias("anchor_id"), key.alias("asked")).distinct().join(best, "asked")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("anchor_id")), 1, positives)
    pairs = named.select("anchor_id", "asked", F.explode(others).alias("p")).select("anchor_id", "asked", F.col("p.id").alias("positive_id"), (-F.col("p.s")).alias("positive_score"))
    return pairs.join(second, ["asked", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", "negative_score")
