"""Conflict-constrained best-fit packing.

Documents, longest first, go to the open bin with the least room that holds them and carries neither too many of their source
nor a copy of them. Bins are kept in order of their room; each carries a bitmap of the sources in it and one of the duplicate
clusters, and from the tightest bin on, successors are tried until one is compatible. Nothing caps that search.

Documents are dealt to shards by a hash of their place in the table (so that copies are spread), about `shard_docs` to each, and each shard is packed on its own: a shard's
table holds lengths and bitmaps, never texts, and costs at most a few half-empty bins. The number of shards follows the input.
"""

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import durable

#: Words to a bin, documents of one source in a bin, and documents to a shard.
CAPACITY, PER_SOURCE, SHARD_DOCS = 2048, 4, 4000


def pack(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """Bin of each item (size, source, cluster), 0 < size <= capacity, in the order given.

    Sources and clusters are small numbers. A source has `per_source` bits in a bin's bitmap, filled from the lowest.
    """
    rooms: dict[int, list[int]] = {}  # room -> bins, in order of opening
    order: list[int] = []  # rooms that have bins, ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        full, mine, copy = 1 << source * per_source + per_source - 1, source * per_source, 1 << cluster
        chosen = -1
        for at in range(bisect_left(order, size), len(order)):
            room = order[at]
            for k, b in enumerate(rooms[room]):
                if not sources[b] & full and not clusters[b] & copy:
                    chosen = b
                    rooms[room].pop(k)
                    if not rooms[room]:
                        del rooms[room]
                        order.pop(at)
                    break
            if chosen >= 0:
                break
        if chosen < 0:
            chosen, room = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        held = sources[chosen] >> mine & (1 << per_source) - 1
        sources[chosen] |= (held + 1) << mine  # 0, 1, 11, 111, ... in bits
        clusters[chosen] |= copy
        left = room - size
        if left:
            if left not in rooms:
                rooms[left] = []
                insort(order, left)
            rooms[left].append(chosen)
        out.append(chosen)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each piece: (doc_id, piece, first_word, n_words, bin_id, n_bin_words).

    A text longer than a bin is cut at every `capacity` words: whole pieces have a bin each, the rest is packed. An empty or
    null text has one piece of no words and takes one word's room, so that it is in a bin, too. Copies (the same words)
    form a cluster, of which a bin has at most one; a null source is a source. Repeated rows are copies, each with bins of its own.
    Ties go by content, then id, then place in the table. Other columns are not read.
    """
    same = F.xxhash64(F.regexp_replace(F.trim(F.lower(F.coalesce(F.col(text_col), F.lit("")))), r"\s+", " "))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(text_col, F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("total"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"), same.alias("cluster"), F.monotonically_increasing_id().alias("row"))
    rows = durable(rows)  # whole texts are read once, and a row's number holds from here on
    n_shards = max(1, -(-rows.count() // shard_docs))
    rows = rows.withColumn("shard", F.pmod(F.hash("row", "cluster"), F.lit(n_shards)))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("total") / capacity) - 1))))
    pieces = pieces.withColumn("first_word", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("total") - F.col("first_word")))
    schema = "doc_id bigint, piece bigint, first_word bigint, n_words bigint, bin_id string, n_bin_words bigint"
    full = pieces.where(F.col("n_words") == capacity)
    alone = full.select("doc_id", "piece", "first_word", "n_words", F.format_string("full-%d-%d", "row", "piece").alias("bin_id"), F.col("n_words").alias("n_bin_words"))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "cluster", "source", "doc_id", "row"], ascending=[False, True, True, True, True], kind="stable")
        source, cluster = pdf["source"].factorize()[0], pdf["cluster"].factorize()[0]
        sizes = pdf["n_words"].clip(lower=1)
        bins = pack(list(zip(sizes.tolist(), source.tolist(), cluster.tolist(), strict=True)), capacity, per_source)
        out = pdf[["doc_id", "piece", "first_word", "n_words"]].copy()
        out["bin_id"] = [f"{k}-{b}" for k, b in zip(pdf["shard"], bins, strict=True)]
        out["n_bin_words"] = out.groupby("bin_id")["n_words"].transform("sum")
        return out

    rest = pieces.where(F.col("n_words") < capacity).select("doc_id", "piece", "first_word", "n_words", "source", "cluster", "row", "shard")
    return rest.groupBy("shard").applyInPandas(shard, schema).unionByName(alone)
