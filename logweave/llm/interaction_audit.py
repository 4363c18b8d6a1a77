"""How five filters interact: what each removes, at each place of each order, from one CUBE over their failure flags.

Every document becomes five flags. Rows are first added up by (part, flags), at most 32 rows a part, and CUBE runs over these: in the
grouping set that selects a subset of the flags, the rows whose selected flags are all false are the subset's survivors. A step of an order
is a pair of subsets, the filters before it and those with its own, so every count of a step is a difference of two survivor counts;
the pairs are joined, and all 120 orders share them.

"Identical to a smaller doc_id's text" needs no join of texts: rows are counted by digest (SHA-256) and flags with the least doc_id and
the rows that have it, so a text that a third of all rows share meets itself as a row for each task, part and label.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"
MEASURES = ["n", "good", "toxic"]


def own_flags(text: Column) -> dict[str, Column]:
    """Failures that follow from the text alone."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, n, good, toxic): counts of documents, at most 32 rows a part.

    Null texts are empty, null languages the part ''. A document is good (toxic) if a row of `labels` of its id says so. A row whose doc_id is null
    has no smaller doc_id, and is none; of repeated rows of one doc_id none is smaller.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(f) for f, c in own_flags(F.col("text")).items()))
    marked = labels.groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(marked, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    alike = ["digest", "part", "A", "B", "C", "D", "good", "toxic"]
    each = rows.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = each.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nameless")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = groups.withColumn("passing", passing).withColumn("E", F.explode(F.array(F.lit(False), F.lit(True))))
    split = split.withColumn("n", F.when(F.col("E"), F.col("n") - F.col("passing")).otherwise(F.col("passing")))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.where("n > 0").groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, chosen, n, good, toxic): documents that fail none of the chosen filters (a bit each), for all 32 subsets of each part."""
    cube = counts.cube("part", *FILTERS).agg(*(F.sum(m).alias(m) for m in MEASURES), F.grouping("part").alias("whole"), *(F.grouping(f).alias(f"any_{f}") for f in FILTERS))
    chosen = sum((F.shiftleft(1 - F.col(f"any_{f}").cast("int"), i) for i, f in enumerate(FILTERS)), F.lit(0))
    alive = F.lit(True)
    for f in FILTERS:
        alive &= (F.col(f"any_{f}") == 1) | ~F.col(f)
    cube = cube.where("whole = 0").select("part", chosen.alias("chosen"), *(F.when(alive, F.col(m)).otherwise(0).alias(m) for m in MEASURES))
    return cube.groupBy("part", "chosen").agg(*(F.sum(m).alias(m) for m in MEASURES))


def steps() -> list[tuple[str, int, str, int, int]]:
    """(order, step, filter, subset before, subset after) of all orders: 600 rows."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            after = before | 1 << FILTERS.index(f)
            out.append(("".join(order), k, f, before, after))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step, zeros included; an empty table gives none.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley as sums of documents; `filter` is the step's letter.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("filter", T.StringType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])
    orders = spark.createDataFrame(steps(), schema)  # 600 rows, whatever the data
    alive = survivors(flagged(docs, labels))
    named = lambda tag: alive.select("part", F.col("chosen").alias(tag), *(F.col(m).alias(f"{m}_{tag}") for m in MEASURES))
    pairs = F.broadcast(orders.select("filter", "before", "after").distinct()).join(named("before"), "before")  # 80 pairs of subsets
    pairs = pairs.join(named("after"), ["part", "after"])
    lost = {"removed": "n", "good_lost": "good", "toxic_lost": "toxic"}
    pairs = pairs.select("part", "filter", "before", F.col("n_after").alias("kept"), *((F.col(f"{m}_before") - F.col(f"{m}_after")).alias(c) for c, m in lost.items()), (F.col("after") == (1 << len(FILTERS)) - 1).alias("last"))
    one = Window.partitionBy("part", "filter")
    at = lambda where: F.sum(F.when(where, F.col("removed")).otherwise(0)).over(one)
    pairs = pairs.withColumn("failing", at(F.col("before") == 0)).withColumn("unique_fails", at(F.col("last")))
    out = pairs.join(F.broadcast(orders.select("filter_order", "step", "filter", "before")), ["filter", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(one).alias("shapley"), "filter")
