"""Removal of long repeats by distributed prefix doubling over anchored positions.

A byte goes if a string of `span` bytes over it also starts elsewhere. Plain prefix doubling ranks every byte position, sorts
pairs (rank of a prefix, rank of the prefix that follows) and ranks anew at growing offsets. Here positions are first tied to
anchors, so that a few rows stand for hundreds of positions, and ranks are 128-bit names of the strings (equal names are taken for equal strings), which
need no global order:

1. Each start of a `span`-byte string belongs to an anchor, the place of the least hash of GRAM bytes in the string. Equal
   strings have their anchor at the same distance. Starts of an anchor at distances j * step ... (j + 1) * step - 1 are a
   block; a block's core is what all its strings share, its hull what they cover together. A core's rank is named by the
   pair of names of its two halves.
2. A round ranks the cores (at growing length: step = 256, 16, 1 gives 145, 385, 400 bytes) by a grouped count. Blocks whose
   core is unique are done: no string of theirs is repeated. Blocks whose hull is repeated are done: all are. The others are
   split, and go on with longer cores (with a witness of the done blocks that share their core); at step 1 core, hull and string are one.

So only places where repeats begin or end are ever looked at closely, and copies of whole documents are done in the first
round. Counts are pre-aggregated, and rows learn of them by joins in which the rows of a hot rank are dealt over many tasks (`known`).

Strings are of bytes, or of words: then a text is an array of 64-bit names of its words, and all lengths are in words.
All copies of a string may go, or all but the first: then a block goes if an equal one is at an earlier place, and the earliest of
the equal ones stands for them in the next round.
"""

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import BATCH_ROWS, durable, map_rows, texts

SPAN, WORDS = 400, 50
#: Bytes and words to a gram.
GRAM, WORD_GRAM = 24, 3
MOST_WORDS = 300_000
#: Bytes of text that are hashed at once.
SLAB = 1 << 19
#: Joins deal the rows of a rank over tasks in pieces of at most about a PARTS-th of all rows.
PARTS = 4096
_PLACE = (1 << 21) - 1
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def steps_of(span: int) -> tuple[int, ...]:
    """The steps of the rounds: for 400 bytes 256, 16, 1, for 50 words 32, 2, 1. A core has a third of the span at least, and distances have ten bits."""
    if not 4 <= span <= 1000:
        raise ValueError(f"span: {span}, not from 4 to 1000")
    step, out = 1 << (2 * span // 3).bit_length() - 1, []
    while step > 1:
        out.append(step)
        step >>= 4
    return (*out, 1)


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def of_bytes(text: str) -> np.ndarray:
    return np.frombuffer(encoded(text), np.uint8)


_NAMES: dict[str, bytes] = {}


def of_words(text: str) -> np.ndarray:
    """64-bit names of the words."""
    import xxhash

    words = text.split()
    if len(_NAMES) > MOST_WORDS:
        _NAMES.clear()
    for w in words:
        if w not in _NAMES:
            _NAMES[w] = xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass"))
    return np.frombuffer(b"".join(map(_NAMES.__getitem__, words)), _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(31)) * _U(0x7FB5D329728EA185)
    x = (x ^ x >> _U(27)) * _U(0x81DADEF4BC2DD44D)
    return x ^ x >> _U(33)


def _powers(base: _U, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(n, base, _U))))


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo 2 ** 64, up to n."""
    if not _TABLES or len(_TABLES[0][0]) <= n:
        _TABLES[:] = [(_powers(b, n), _powers(_U(pow(int(b), -1, 1 << 64)), n)) for b in _BASES]
    return _TABLES


class Names:
    """Two 64-bit names of any substring of at least 9 bytes, from sums over mixed 8-byte groups; of words, of any substring of at least two.

    The first sums up values of groups, the second values of pairs of neighbours, mixed apart from those. So orders of two words whose sums of
    powers cancel out in one name (as in a Thue-Morse sequence) don't do so in the other.
    """

    def __init__(self, data: np.ndarray, both: bool = True):
        self.reach = 7 if data.dtype == np.uint8 else 0
        n = max(0, len(data) - self.reach)
        groups = data if not self.reach else np.ndarray((n,), "<u8", data.tobytes(), strides=(1,)) if n else np.zeros(0, _U)
        groups = groups.astype(_U)
        mixed = [_mix(groups)]
        if both:
            mixed.append(_mix(_mix(groups[:-1] ^ _U(0xA24BAED4963EE407)) * _U(0x9FB21C651E98DF25) + groups[1:]))
        self.sums, self.back = [], []
        for values, (powers, inverse) in zip(mixed, _tables(len(data) + 1), strict=False):
            self.sums.append(np.concatenate((np.zeros(1, _U), np.cumsum(values * powers[: len(values)], dtype=_U))))
            self.back.append(inverse)

    def of(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        return _mix((self.sums[k][end - self.reach - k] - self.sums[k][start]) * self.back[k][start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    n = len(values)
    wide = np.full(-(-n // width) * width, ~_U(0), _U)
    wide[:n] = values
    rows = wide.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _keys(names: Names, base: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, span: int):
    """Ranks of blocks: of the core, a pair named anew; of the hull, two names. anchor is a place in the slab."""
    block = low // step
    start, end = anchor - block * step, anchor - (block * step + step - 1) + span
    half = np.maximum((end - start + 1) // 2, names.reach + 1)
    core = _mix(names.of(start, start + half) * _U(3) + names.of(end - half, end) + block.astype(_U))
    start, end = anchor - high, anchor - low + span
    apart = _mix(low.astype(_U) << _U(20) | high.astype(_U))
    return core, names.of(start, end) ^ apart, names.of(start, end, 1) + apart


def anchored(whole: np.ndarray, step: int = 256, span: int = SPAN):
    """Slabs of blocks of one text: (anchor, low, high, core, hull, hull2) as arrays; anchor is a place in the text."""
    gram = GRAM if whole.dtype == np.uint8 else WORD_GRAM
    for at in range(0, max(1, len(whole) - span + 1), SLAB):
        part = whole[at : at + SLAB + span - 1]
        if len(part) < span:
            return
        names = Names(part)
        places = np.arange(len(part) - gram + 1)
        order = names.of(places, places + gram) & ~_U(_PLACE) | places.astype(_U)
        anchor = (_least(order, span - gram + 1) & _U(_PLACE)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
        anchor = anchor[first]
        low, high = anchor - last, anchor - first
        anchor, low, high = split(anchor, low, high, step)
        yield (anchor + at, low, high, np.zeros(len(low), bool), *_keys(names, part, anchor, low, high, step, span))


def split(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, step: int):
    """Cuts ranges of distances at multiples of step."""
    n = high // step - low // step + 1
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = (low[at] // step + k) * step
    return anchor[at], np.maximum(low[at], begin), np.minimum(high[at], begin + step - 1)


def rekeyed(whole: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, witness: np.ndarray, step: int, span: int = SPAN):
    """Ranks of the split blocks of one text, slab by slab."""
    witness = np.repeat(witness, high // step - low // step + 1)
    anchor, low, high = split(anchor, low, high, step)
    slab = (anchor - high) // SLAB
    for s in np.unique(slab):
        at, mine = int(s) * SLAB, slab == s
        # Cores reach up to a step before the block's first string and past its last.
        begin = max(0, at - 2 * span)
        names = Names(whole[begin : at + SLAB + 3 * span])
        a, lo, hi = anchor[mine], low[mine], high[mine]
        yield (a, lo, hi, witness[mine], *_keys(names, whole, a - begin, lo, hi, step, span))


ROWS = "doc_key bigint, text_key bigint, place bigint, low int, high int, witness boolean, core bigint, hull bigint, hull2 bigint"


def _emit(df: DataFrame, f) -> DataFrame:
    """f(text bytes, places, ranges) -> slabs; df has doc_key, text_key, text and maybe found (packed blocks)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = to_arrow_schema(StructType.fromDDL(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for anchor, low, high, witness, core, hull, hull2 in f(*r[2:]):
                    m = len(anchor)
                    held.append((np.full(m, r[0]), np.full(m, r[1]), anchor, low, high, witness, core.view(np.int64), hull.view(np.int64), hull2.view(np.int64)))
                    n += m
                    if n > 65_536:
                        yield batch(held)
                        held, n = [], 0
            if held:
                yield batch(held)

    def batch(held) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i in (3, 4) else c) for i, c in enumerate(cols)], schema=schema)

    return df.mapInArrow(run, ROWS)


def _settle(rows: DataFrame, last: bool, keep_first: bool) -> tuple[DataFrame, DataFrame | None]:
    """Of a round's blocks: (those that go, those still open with their witnesses). Blocks with a unique core are done with.

    Where all copies go, equal blocks that are done leave one of them behind as a witness if their core has open blocks, too: those may
    yet share shorter strings with it. Where the first stays, it is still open if its core has other blocks.
    """
    own = ["doc_key", "text_key", "place", "low", "high"]
    if not last:
        often = rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
        rows = known(rows, often, ["core"], own)
    rows = durable(rows)
    hulls = durable(rows.groupBy("core", "hull", "hull2").agg(F.count("*").alias("n"), F.max("witness").alias("witness"), F.min(F.struct(*own)).alias("one")))
    pair = ["hull", "hull2"]
    if keep_first:
        first = known(rows, hulls.where("n > 1").select(*pair, "n", "one"), pair, own, "inner")
        done = first.where(F.struct(*own) != F.col("one")).select(*KEY, "place", "low", "high")
        if last:
            return done, None
        mixed = hulls.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
        return done, known(hulls, mixed, ["core"], pair).select("one.*", F.lit(False).alias("witness"))
    done = known(rows.where("not witness"), hulls.where("n > 1").select(*pair, "n"), pair, own).select(*KEY, "place", "low", "high")
    if last:
        return done, None
    alone = F.expr("n = 1 and not witness")
    open_ = hulls.where(alone).select("one.*", F.lit(False).alias("witness"))
    wanted = hulls.groupBy("core").agg(F.count_if(~alone).alias("n"), F.bool_or(alone).alias("_any")).where("_any and n > 0").select("core", "n")
    seen = known(hulls.where(~alone), wanted, ["core"], pair).select("one.*", F.lit(True).alias("witness"))
    return done, open_.unionByName(seen)


def known(rows: DataFrame, keys: DataFrame, on: list[str], own: list[str], how: str = "left_semi") -> DataFrame:
    """rows that have one of the keys, with no task's share larger for a hot key. keys: (on, n, ...), n being how many rows have the key.

    A key of more than a PARTS-th of all n is hot: there are fewer than PARTS of these, whatever the data, so they are broadcast; its rows
    are dealt by `own` (columns that tell them apart) over n * PARTS / total pieces, and the key is repeated for each piece, at most
    2 * PARTS rows in all.
    """
    keys = durable(keys)
    total = keys.agg(F.sum("n")).first()[0] or 1
    pieces = F.ceil(F.col("n") * PARTS / total)
    hot = keys.where(F.col("n") * PARTS > total).select(*on, pieces.alias("_pieces"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*own), "_pieces"), F.lit(0))).drop("_pieces")
    each = keys.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1))).drop("n")
    return dealt.join(each, [*on, "_piece"], how).drop("_piece")


KEY = ["doc_key", "text_key"]


def _blocks(found: DataFrame) -> DataFrame:
    """Blocks of each text as one array; a text has at most a few for each of its own `span` bytes."""
    marked = F.shiftleft(F.col("witness").cast("bigint"), 20) if "witness" in found.columns else F.lit(0)
    packed = F.shiftleft("place", 21).bitwiseOR(marked).bitwiseOR(F.shiftleft(F.col("low").cast("bigint"), 10)).bitwiseOR(F.col("high").cast("bigint"))
    return found.groupBy(*KEY).agg(F.collect_set(packed).alias("found"))  # of repeated rows each block once


def unpack(found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, least and greatest distances, and whether it is a witness."""
    x = np.unique(np.array(found, np.int64))
    return x >> 21, x >> 10 & 1023, x & 1023, (x >> 20 & 1).astype(bool)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text: equal rows (a repeated row) have equal results."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("doc_key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("text_key", F.xxhash64("text"))


def repeats(docs: DataFrame, span: int = SPAN, units=of_bytes, keep_first: bool = False) -> DataFrame:
    """(doc_key, text_key, found): packed blocks of starts whose strings of `span` units of the text go. docs as `keyed` gives them."""
    steps = steps_of(span)
    if units is of_bytes and span < 32:
        raise ValueError(f"span: {span} bytes, under 32")
    least = span if units is of_bytes else 2 * span - 1
    long = docs.where(F.octet_length("text") >= least).select(*KEY, "text")
    rows = _emit(long, lambda text: anchored(units(text), steps[0], span))
    done, open_ = _settle(rows, len(steps) == 1, keep_first)
    for i, step in enumerate(steps[1:], 2):
        again = long.join(_blocks(open_), KEY, "inner").select(*KEY, "text", "found")
        rows = _emit(again, lambda text, found, step=step: rekeyed(units(text), *unpack(found), step, span))
        more, open_ = _settle(rows, i == len(steps), keep_first)
        done = done.unionByName(more)
    return _blocks(done)


def removed_runs(found, span: int = SPAN) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of removed bytes."""
    if not len(found):
        return []
    place, low, high, _ = unpack(found)
    start, end = place - high, place - low + span
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return list(zip(start[new].tolist(), end[np.concatenate((new[1:], [True]))].tolist(), strict=True))


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join((*out, data[at:])) if runs else data


_WORD = re.compile(r"\S+")


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the runs of words; the white space behind a removed word goes, too."""
    if not runs:
        return text
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for a, b in runs:
        out.append(text[done : at[a]])
        done = at[b]
    return "".join((*out, text[done:]))


def with_runs(docs: DataFrame, shape, schema: str, extra: list[str] = (), span: int = SPAN, units=of_bytes, keep_first: bool = False) -> DataFrame:
    """Applies shape(doc_id, text, runs, *extra) to every row; each row meets the blocks of its text."""
    docs = keyed(docs)
    found = repeats(docs, span, units, keep_first)
    both = docs.join(found, KEY, "left").select("doc_id", "text", "found", *extra)

    def rows(source):
        for doc_id, text, blocks, *more in source:
            yield shape(doc_id, text, removed_runs(blocks or (), span), *more)

    return map_rows(both, rows, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, keep_first: bool = False) -> DataFrame:
    """(doc_id, kept, spans) for every row: the text without repeats (bytes, for a cut may fall inside a character), and the removed [start, end) pairs.

    Null counts as the empty text; texts under `span` bytes stay whole; repeated rows count as repeats of each other, but where the
    first copy stays, that of a repeated row is the first in each of them. span: from 32 to 1000.
    """
    shape = lambda doc_id, text, runs: (doc_id, cut(encoded(text), runs), [list(r) for r in runs])
    return with_runs(texts(docs, id_col, text_col), shape, "doc_id bigint, kept binary, spans array<array<bigint>>", span=span, keep_first=keep_first)


def digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The query's columns, and the remaining text (null where a cut fell inside a character)."""

    def shape(doc_id, text, runs):
        data = encoded(text)
        kept = cut(data, runs)
        try:
            left = kept.decode()
        except UnicodeDecodeError:
            left = None
        return doc_id, len(data), len(data) - len(kept), len(runs), sha256(kept).hexdigest(), left

    return with_runs(texts(docs), shape, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string", span=span)


def cleaned(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with `text` cut, and n_chars to match; other columns as they were.

    Of each passage of at least `words` words (from 4 to 1000) that is there more than once, all but the first place (least doc_id, null
    ids before all, then place) go. A row stays even if its whole text goes; repeated rows stay alike; a null text becomes empty.
    """
    names = docs.columns
    hold = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in names if c != "text"]).alias("rest"))
    schema = f"text string, rest {hold.schema['rest'].dataType.simpleString()}"
    shape = lambda doc_id, text, runs, rest: (cut_words(text, runs), rest)
    out = with_runs(hold, shape, schema, ["rest"], words, of_words, keep_first=True)
    kinds = dict(docs.dtypes)
    cols = [F.col("text") if c == "text" else F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in names]
    return out.select(*cols)
