"""Comparing logs place by place through trees of digests: only the ranges whose digests differ are looked at.

The rows of a log (lines by number, chunks by seq, slices by part) are dealt by ranges of LEAF places; a leaf is the digest of its rows in order. Inner nodes
are digests of FANOUT children, and the root is that of the log. Two logs are compared from the roots down, and the rows of unequal leaves are joined on their
place. Digests are 16 bytes a row before they are folded, so a log's text is moved only where it differs, and one log is many leaves.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, FANOUT, INNER = 256, 64, 2


def _folded(rows: DataFrame, keys: list[str], at: Column, order: str, name: str) -> DataFrame:
    """(keys, name, digest) of rows (keys, order, digest), folded in order."""
    made = F.unhex(F.md5(F.expr(f"listagg(_place) within group (order by {order}, _place)")))
    return rows.withColumn("_place", F.concat(F.encode(F.col(order).cast("string"), "utf-8"), F.lit(b":"), F.col("digest"))).withColumn(name, at).groupBy(*keys, name).agg(made.alias("digest"))


def tree(rows: DataFrame, keys: list[str], position: str, value: str, leaf: int = LEAF, fanout: int = FANOUT, inner: int = INNER) -> list[DataFrame]:
    """Levels from the leaves up, each (keys, node, digest); the last has one node a log. Null values differ from empty ones, and repeated places count."""
    data = F.coalesce(F.concat(F.lit(b"\x01"), F.col(value).cast("binary")), F.lit(b"\x00"))
    each = rows.select(*keys, F.col(position).cast("bigint").alias("_at"), F.unhex(F.md5(data)).alias("digest"))
    levels = [_folded(each, keys, F.floor(F.col("_at") / leaf), "_at", "node")]
    for _ in range(inner):
        levels.append(_folded(levels[-1].withColumnRenamed("node", "_child"), keys, F.floor(F.col("_child") / fanout), "_child", "node"))
    return [*levels, _folded(levels[-1].withColumnRenamed("node", "_child"), keys, F.lit(0).cast("bigint"), "_child", "node")]


def unequal(a: list[DataFrame], b: list[DataFrame], keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, node) of the leaves that differ or are on one side only: from the roots down, children of unequal nodes only."""
    open_ = None
    for depth, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=True)):
        if open_ is not None:
            parent = F.lit(0).cast("bigint") if depth == 1 else F.floor(F.col("node") / fanout)
            x, y = (t.withColumn("_parent", parent).join(open_.withColumnRenamed("node", "_parent"), [*keys, "_parent"], "left_semi").drop("_parent") for t in (x, y))
        both = x.withColumnRenamed("digest", "_a").join(y.withColumnRenamed("digest", "_b"), [*keys, "node"], "full")
        open_ = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, "node")
    return open_


def differences(a: DataFrame, b: DataFrame, keys: list[str], position: str, value: str, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(keys, position, source, rebuilt, side) of the places whose values differ; side: changed, source (b lacks the place) or rebuilt (a does).

    Places are unique within a log; rows at a repeated place are compared with each of the other side's.
    """
    where = unequal(tree(a, keys, position, value, leaf, fanout), tree(b, keys, position, value, leaf, fanout), keys, fanout)
    near = lambda t, name: t.select(*keys, F.col(position), F.col(value).alias(name), F.lit(True).alias(f"_{name}"), F.floor(F.col(position) / leaf).alias("node")).join(where, [*keys, "node"], "left_semi").drop("node")
    both = near(a, "source").join(near(b, "rebuilt"), [*keys, position], "full")
    side = F.when(F.col("_rebuilt").isNull(), "source").when(F.col("_source").isNull(), "rebuilt").otherwise("changed")
    return both.withColumn("side", side).where((F.col("side") != "changed") | ~F.col("source").eqNullSafe(F.col("rebuilt"))).drop("_source", "_rebuilt")


def equal(a: DataFrame, b: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """(keys, equal) of every log of either side, by roots alone."""
    x, y = (tree(t, keys, position, value)[-1] for t in (a, b))
    both = x.withColumnRenamed("digest", "_a").join(y.withColumnRenamed("digest", "_b"), [*keys, "node"], "full")
    return both.select(*keys, F.col("_a").eqNullSafe(F.col("_b")).alias("equal"))
