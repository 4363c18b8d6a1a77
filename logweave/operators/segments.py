"""Ordered maps (id, session) -> number -> value in sorted segments, so that no session is a row and merging moves segments, not entries.

A segment holds the numbers of one range of SEGMENT numbers: `part` names the range, `at` has the numbers as distances from its start (ascending, each
once), `values` the values beside them. Maps merge by (id, session, part): only segments that several maps have are opened, and of equal numbers
the later map's value stays. Rows without a number are left out; a null id or session is a key of its own; a null value is a value.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers to a segment: with the largest chunks as values a segment has 16 MiB.
SEGMENT = 256
LOG = ("id", "session")
PLACE = (*LOG, "part")


def _part(seq: Column, span: int) -> Column:
    """The range of a number; in whole numbers, for a division would make large ones doubles."""
    if span < 1 or span & (span - 1):
        raise ValueError(f"span is no power of two: {span}")
    return F.shiftright(seq, span.bit_length() - 1)


def segments_of(df: DataFrame, value: str, *arrival: str | Column, span: int = SEGMENT) -> DataFrame:
    """(id, session, part, at, values). Of equal numbers the row that arrived last stays; with no order the one with the largest value, nulls least.

    Copies of a number are folded before each shuffle; both are dealt by number or segment, so a hot session or a hot number is many tasks' work.
    """
    seq = F.col("seq").cast("bigint")
    rows = df.where("seq is not null").withColumns({"_seq": seq, "_part": _part(seq, span)})
    one = F.max_by(F.struct(value), F.struct(*arrival)) if arrival else F.struct(F.max(value).alias(value))
    each = rows.groupBy(*LOG, F.col("_part").alias("part"), F.col("_seq").alias("seq")).agg(one.alias("_one"))
    entry = F.struct((F.col("seq") - F.col("part") * span).cast("int").alias("at"), F.col("_one")[value].alias("value"))
    packed = each.groupBy(*PLACE).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return packed.select(*PLACE, F.col("_e.at").alias("at"), F.col("_e.value").alias("values"))


def merge(*maps: DataFrame) -> DataFrame:
    """The union of maps of one span, and `shared`: for each entry whether more than one map has it. One shuffle of segments for any number of maps."""
    tagged = [m.select(*PLACE, F.lit(k).alias("_k"), "at", "values") for k, m in enumerate(maps)]
    entries = F.transform(F.arrays_zip("at", "values"), lambda e: F.struct(e["at"].alias("at"), F.col("_k").alias("k"), e["values"].alias("value")))
    rows = reduce(DataFrame.unionByName, tagged).select(*PLACE, entries.alias("_e"))
    both = rows.groupBy(*PLACE).agg(F.array_sort(F.flatten(F.collect_list("_e"))).alias("_e"))
    e = F.col("_e")
    # Entries of one number stand side by side, the later map's last.
    last = F.filter(F.transform(e, lambda x, i: F.struct(x["at"].alias("at"), x["value"].alias("value"), F.coalesce(F.get(e, i - 1)["at"] == x["at"], F.lit(False)).alias("shared"), F.coalesce(F.get(e, i + 1)["at"] != x["at"], F.lit(True)).alias("last"))), lambda x: x["last"])
    return both.select(*PLACE, last.alias("_e")).select(*PLACE, F.col("_e.at").alias("at"), F.col("_e.value").alias("values"), F.col("_e.shared").alias("shared"))


def entries(segments: DataFrame, value: str, span: int = SEGMENT) -> DataFrame:
    """(id, session, seq, value), and `shared` where the segments have it; in order within each segment."""
    more = ["shared"] if "shared" in segments.columns else []
    each = segments.select(*PLACE, F.explode(F.arrays_zip("at", "values", *more)).alias("_e"))
    return each.select(*LOG, (F.col("part") * span + F.col("_e.at")).alias("seq"), F.col("_e.values").alias(value), *(F.col(f"_e.{m}").alias(m) for m in more))


def lookup(segments: DataFrame, wanted: DataFrame, value: str, span: int = SEGMENT) -> DataFrame:
    """`wanted` (id, session, seq, any others) with `value` and `found`; each wanted row meets one segment."""
    seq = F.col("seq").cast("bigint")
    asked = wanted.withColumn("_part", _part(seq, span)).withColumn("_at", (seq - F.col("_part") * span).cast("int"))
    held = segments.select(*(F.col(c).alias(f"_k_{c}") for c in PLACE), F.col("at").alias("_numbers"), F.col("values").alias("_values"))
    same = F.col("id").eqNullSafe(F.col("_k_id")) & F.col("session").eqNullSafe(F.col("_k_session")) & (F.col("_part") == F.col("_k_part"))
    place = F.array_position("_numbers", F.col("_at")).cast("int")
    met = asked.join(held, same, "left").withColumn("_place", F.coalesce(place, F.lit(0)))
    return met.select(*wanted.columns, F.get("_values", F.col("_place") - 1).alias(value), (F.col("_place") > 0).alias("found"))


def numbers(segments: DataFrame, span: int = SEGMENT) -> DataFrame:
    """(id, session, low, high, entries) of each log, from the segments' ends: values aren't read."""
    n = F.size("at")
    low, high = F.col("part") * span + F.get("at", F.lit(0)), F.col("part") * span + F.get("at", n - 1)
    return segments.select(*LOG, low.alias("low"), high.alias("high"), n.cast("bigint").alias("n")).groupBy(*LOG).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("entries"))
