"""Segmented scans that survive a hot key: for each row, an associative operation over the rows before it in its key.

A plain window puts a whole key into one task. Here a key's rows are dealt by ranges of their position as well; each range is scanned by itself
and folded to one row, the (few) range rows are scanned in order, and the two are combined. The second step sees one row per
key and range.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions to a range.
SPAN = 65_536


@dataclass(frozen=True)
class Op:
    """An associative operation. over: as a window function over earlier values; fold: a range's rows in order of `at` to one value; join: (ahead, here)."""

    over: Callable[[Column], Column]
    fold: Callable[[Column, Column], Column]
    join: Callable[[Column, Column], Column]


def _last(value: Column) -> Column:
    return F.last(value, ignorenulls=True)


SUM = Op(F.sum, lambda v, at: F.sum(v), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
MAX = Op(F.max, lambda v, at: F.max(v), lambda a, b: F.greatest(a, b))
MIN = Op(F.min, lambda v, at: F.min(v), lambda a, b: F.least(a, b))
#: The last value that isn't null.
LAST = Op(_last, lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), lambda a, b: F.coalesce(b, a))


def ranged(df: DataFrame, keys: list[str], position: str, span: int = SPAN) -> DataFrame:
    """Adds `_range` and deals by key and range; the steps below reuse this one shuffle."""
    return df.withColumn("_range", F.floor(F.col(position) / span)).repartition(*keys, "_range")


def scan(df: DataFrame, keys: list[str], position: str, values: dict[str, tuple[Op, Column]], order: list[str] = (), span: int = SPAN, least: dict[str, Column] | None = None, inclusive: bool = False) -> DataFrame:
    """Adds for each name: (operation, value) the result over the key's earlier rows (inclusive: and the row itself); for each of `least` the key's minimum.

    Rows are ordered by `position` (a long; nulls first), and where that ties by `order`; rows that tie in both get
    their places in any order. Null keys form a key of their own. Where no earlier row has a value the result is null, of sums 0.
    """
    if "_range" not in df.columns:
        df = ranged(df, keys, position, span)
    upto = Window.partitionBy(*keys, "_range").orderBy(position, *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = df.withColumns({f"_value_{n}": v for n, (_, v) in values.items()})
    least = least or {}
    at = F.struct(F.col(position), *(F.col(c) for c in order))
    totals = df.groupBy(*keys, "_range").agg(*(op.fold(F.col(f"_value_{n}"), at).alias(n) for n, (op, _) in values.items()), *(F.min(c).alias(n) for n, c in least.items()))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_kr"), *(op.over(F.col(n)).over(ahead).alias(f"_ahead_{n}") for n, (op, _) in values.items()), *(F.min(n).over(Window.partitionBy(*keys)).alias(n) for n in least))
    same = F.col("_range").eqNullSafe(F.col("_kr"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = df.withColumns({f"_local_{n}": op.over(F.col(f"_value_{n}")).over(upto) for n, (op, _) in values.items()})
    out = local.join(totals, same, "left").withColumns({n: op.join(F.col(f"_ahead_{n}"), F.col(f"_local_{n}")) for n, (op, _) in values.items()})
    return out.drop("_range", "_kr", *(f"_k{i}" for i in range(len(keys))), *(f"_{p}_{n}" for n in values for p in ("value", "local", "ahead")))


def running_totals(df: DataFrame, keys: list[str], position: str, values: dict[str, Column], order: list[str] = (), span: int = SPAN, least: dict[str, Column] | None = None) -> DataFrame:
    """The scan for sums of longs."""
    return scan(df, keys, position, {n: (SUM, v.cast("bigint")) for n, v in values.items()}, order, span, least)


def running_total(df: DataFrame, keys: list[str], position: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """running_totals for one value; `position` is unique within the key."""
    return running_totals(df, keys, position, {name: value}, span=span)
