"""The engine's data flow, from chunks to logs."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from logweave.operators.assemble import bodies, lines
from logweave.operators.chunks import dedup_last_write
from logweave.operators.sequencing import accepted, decide, gaps, next_tracker


@dataclass(frozen=True)
class Flow:
    """Lazily planned tables of one pass."""

    chunks: DataFrame
    decided: DataFrame
    accepted: DataFrame
    tracker: DataFrame
    gaps: DataFrame
    logs: DataFrame
    lines: DataFrame

    def register(self) -> None:
        """Makes every table a temp view of its name, for Spark SQL."""
        for name in ("chunks", "decided", "accepted", "tracker", "gaps", "logs", "lines"):
            getattr(self, name).createOrReplaceTempView(name)


def rebuild(chunks: DataFrame, *arrival, tracker: DataFrame | None = None, start: str = "first_seen") -> Flow:
    one = dedup_last_write(chunks, *arrival)
    decided = decide(one, tracker, start, chunks)
    taken = accepted(decided)
    logs = bodies(taken)
    return Flow(one, decided, taken, next_tracker(decided), gaps(chunks), logs, lines(logs))
