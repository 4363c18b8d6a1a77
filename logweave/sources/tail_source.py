"""A streaming source that tails files: one chunk of at most 64 KiB for each file and read.

Offsets are JSON: {path: [inode, position, seq, mark, life]}. The engine commits them with the batch, so no byte is lost when a
sink fails, and a batch can be read again from its offsets. Files present at the start are read from their end
(startingOffsets=latest) or start (earliest); later files always from 0. A rotated file is found by its inode in its folder and
read to its end before the new one starts at 0; its inode stays in the offset until then. Truncated files start again at 0, and so
do those that have grown past the position since: the mark is a digest of the file's first bytes and of those before the position (MARK of
each), looked at again whenever there is more to read. The life counts such starts. Numbers go on. A read whose file is gone or too
short fails. Not seen: a rotated file that was deleted, moved to another folder or followed by a second rotation before the next
look, bytes written to a rotated file after its end was reached, and a file written anew with the same bytes at both places of the mark.
"""

import os
import sys
from hashlib import blake2b

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from logweave.schema import CHUNK, MAX_CHUNK

#: Bytes at each of the two places of a mark.
MARK = 4096
#: Bytes and files that a task reads, at most (or one piece).
TASK_BYTES, TASK_FILES = 16 << 20, 256


class Piece(InputPartition):
    def __init__(self, path: str, inode: int, start: int, end: int, seq: int, session: int, size: int):
        self.path, self.inode, self.start, self.end, self.seq, self.session, self.size = path, inode, start, end, seq, session, size


class Pieces(InputPartition):
    """What one task reads: many small files would else be as many tasks."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def dealt(pieces: list[Piece]) -> list[Pieces]:
    out, held = [], 0
    for p in pieces:
        if not out or held + p.end - p.start > TASK_BYTES or len(out[-1].pieces) == TASK_FILES:
            out.append(Pieces([]))
            held = 0
        out[-1].pieces.append(p)
        held += p.end - p.start
    return out


def identity(path: str) -> tuple[int, int] | None:
    """(inode, size), or None for a file that isn't there."""
    try:
        s = os.stat(path)
    except OSError:
        return None
    return s.st_ino, s.st_size


class Folders:
    """Names of files by folder and inode; a folder is looked through once, and again only if a name it gave is another file's by now."""

    def __init__(self):
        self.seen: dict[str, dict[int, str]] = {}

    def find(self, folder: str, inode: int) -> str | None:
        known = folder in self.seen
        there = self._names(folder).get(inode)
        if known and there and (identity(there) or (None,))[0] != inode:
            del self.seen[folder]
            there = self._names(folder).get(inode)
        return there

    def _names(self, folder: str) -> dict[int, str]:
        if folder not in self.seen:
            try:
                with os.scandir(folder) as entries:
                    self.seen[folder] = {e.inode(): e.path for e in entries if e.is_file(follow_symlinks=False)}
            except OSError:
                return {}
        return self.seen[folder]


def located(path: str, inode: int, folders: Folders | None = None) -> str | None:
    """Where the file with this inode is: the path, or another name in its folder after a rotation."""
    now = identity(path)
    if now and now[0] == inode:
        return path
    return (folders or Folders()).find(os.path.dirname(path) or ".", inode)


def mark(path: str, position: int) -> str:
    """Digest of the bytes that tell whether what lies before the position is still what was read; of a file that is too short, of what it has."""
    head = min(MARK, position)
    try:
        with open(path, "rb") as f:
            first = f.read(head)
            f.seek(max(head, position - MARK))
            return blake2b(b"%d:%b%b" % (len(first), first, f.read(position - f.tell())), digest_size=16).hexdigest()
    except OSError:
        return ""


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.paths = [x.strip() for x in options["paths"].split(",") if x.strip()]
        self.session = int(options["session"])
        self.latest = options.get("startingoffsets", options.get("startingOffsets", "latest")) == "latest"
        self.size = int(options.get("chunksize", options.get("chunkSize", MAX_CHUNK)))
        self.reads = int(options.get("maxreads", options.get("maxReads", 1000)))
        self.current: dict | None = None

    def initialOffset(self) -> dict:
        found = {p: identity(p) for p in self.paths}
        starts = {p: (x[0], x[1] if self.latest else 0) for p, x in found.items() if x}
        return {p: [inode, at, 0, mark(p, at), 0] for p, (inode, at) in starts.items()}

    def latestOffset(self) -> dict:
        self.current = self.current if self.current is not None else self.initialOffset()
        self.current = advance(self.current, self.paths, self.size * self.reads, self.size)
        return self.current

    def partitions(self, start: dict, end: dict):
        self.current = end
        out = []
        for path, (inode, at, seq, _, life) in end.items():
            old, was, before, _, lived = start.get(path, [None, 0, 0, "", 0])
            begin = was if old == inode and life == lived else 0
            if seq > before:
                out.append(Piece(path, inode, begin, at, before, self.session, self.size))
        return dealt(out)

    def read(self, partition: Pieces):
        folders = Folders()
        for piece in partition.pieces:
            yield from self._read(piece, folders)

    def _read(self, partition: Piece, folders: Folders):
        id, seq = os.path.basename(partition.path), partition.seq
        there = located(partition.path, partition.inode, folders) or located(partition.path, partition.inode)
        if there is None:
            raise OSError(f"{partition.path}: inode {partition.inode} is gone, bytes {partition.start} to {partition.end} can't be read")
        with open(there, "rb") as f:
            if os.fstat(f.fileno()).st_ino != partition.inode:
                raise OSError(f"{partition.path}: rotated while it was opened")
            f.seek(partition.start)
            for at in range(partition.start, partition.end, partition.size):
                n = min(partition.size, partition.end - at)
                data = f.read(n)
                if len(data) < n:
                    raise OSError(f"{partition.path}: truncated before bytes {at} to {at + n} were read")
                seq += 1
                yield id, partition.session, seq, data


def advance(offsets: dict, paths: list[str], limit: int, size: int) -> dict:
    """The offsets after one look at the files."""
    out, folders = {}, Folders()
    for path in paths:
        found, known = identity(path), offsets.get(path)
        if known and (not found or found[0] != known[0]):
            there = located(path, known[0], folders)
            rest = identity(there) if there else None
            if rest and rest[0] == known[0] and rest[1] > known[1]:
                found = rest
        if not found:
            if known:
                out[path] = known
            continue
        inode, length = found
        old, at, seq, was, life = known or [inode, 0, 0, "", 0]
        there = located(path, inode, folders) or path
        if old != inode:
            at, life = 0, 0
        elif length < at or length > at and at and mark(there, at) != was:
            at, life = 0, life + 1
        end = min(length, at + limit)
        out[path] = [inode, end, seq + -(-(end - at) // size), mark(there, end), life] if end != at or old != inode or at == 0 else [inode, at, seq, was, life]
    return out


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); spark.readStream.format("logtail").option("paths", "a,b").option("session", "1").load()"""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> StructType:
        return CHUNK

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Registers the source so that it also runs where the package is no more than a file given to executors: the process that plans a stream doesn't see those."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TailSource)
