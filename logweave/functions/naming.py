"""File-name functions: every one is a Column expression, so names never leave the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file formats.
CHUNK_SUFFIX = ".pbData"
TRACKER_SUFFIX = ".lastSeq"
CHUNK_PATTERN = r"^(.*)_(\d+)_(\d+)\.pbData$"
TRACKER_PATTERN = r"^(.*)_(\d+)\.lastSeq$"


def chunk_file_name(id: Column, session: Column, seq: Column) -> Column:
    return F.format_string(f"%s_%d_%d{CHUNK_SUFFIX}", id, session, seq)


def rebuilt_name(id: Column, session: Column) -> Column:
    return F.concat_ws(".", id, session.cast("string"))


def tracker_file_name(id: Column, session: Column) -> Column:
    return F.format_string(f"%s_%d{TRACKER_SUFFIX}", id, session)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_chunk_name(name: Column) -> Column:
    return name.endswith(CHUNK_SUFFIX)


def is_tracker_name(name: Column) -> Column:
    return name.endswith(TRACKER_SUFFIX)


def parse_chunk_name(name: Column) -> Column:
    """STRUCT(id, session, seq); null for a name that doesn't fit or whose numbers exceed 64 bits (quarantine)."""
    part = [F.regexp_extract(name, CHUNK_PATTERN, i) for i in (1, 2, 3)]
    session, seq = part[1].try_cast("bigint"), part[2].try_cast("bigint")
    whole = F.struct(part[0].alias("id"), session.alias("session"), seq.alias("seq"))
    return F.when(name.rlike(CHUNK_PATTERN) & session.isNotNull() & seq.isNotNull(), whole)


def parse_tracker_name(name: Column) -> Column:
    """STRUCT(id, session); null for a name that doesn't fit."""
    session = F.regexp_extract(name, TRACKER_PATTERN, 2).try_cast("bigint")
    whole = F.struct(F.regexp_extract(name, TRACKER_PATTERN, 1).alias("id"), session.alias("session"))
    return F.when(name.rlike(TRACKER_PATTERN) & session.isNotNull(), whole)


def is_safe_id(id: Column) -> Column:
    """False for ids that would leave the folder they are written to."""
    return id.isNotNull() & ~id.rlike(r"[/\\\x00]") & ~id.isin("", ".", "..")


def describe_chunk(id: Column, session: Column, seq: Column, size: Column) -> Column:
    return F.format_string("Name: %s Session: %d Seq: %d Payload: %d", id, session, seq, size)


def normal_path(path: Column) -> Column:
    """Without empty and `.` steps, and with `..` steps undone; a leading `/` stays, and `..` above it goes."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")

    def step(done, x):
        up = (x == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        above = (x == "..") & rooted & (F.size(done) == 0)
        return F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).when(above, done).otherwise(F.concat(done, F.array(x)))

    out = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), out)).when(out == "", ".").otherwise(out)


def last_token(line: Column) -> Column:
    return F.element_at(F.split(F.trim(line), r"\s+"), -1)
