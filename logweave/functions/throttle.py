"""Back-pressure: replies, waiting times and the throttle setting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.running import LAST, SPAN, scan

# Fixed value of the protocol.
PREFIX = "Throttle: "


def reply(seconds: Column) -> Column:
    return F.format_string(f"{PREFIX}%d", seconds)


def parse_reply(body: Column) -> Column:
    """Seconds of a reply that starts with the prefix; null (no change) for anything else."""
    return F.when(body.startswith(PREFIX), F.trim(F.substring(body, len(PREFIX) + 1, 2**31 - 1)).try_cast("int"))


def sleep_until(now_ms: Column, seconds: Column) -> Column:
    """In 64 bits, so that long waits don't wrap."""
    return now_ms + seconds.cast("bigint") * 1000


def remaining_sleep(until_ms: Column, now_ms: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), until_ms - now_ms)


def settings(commands: DataFrame, seconds: str, at: str, scope: list[str], name: str = "in_force", span: int = SPAN) -> DataFrame:
    """Adds the value in force after each command of its scope, in order of `at` (a long): a negative one only reads; 0 before the first."""
    asked = F.when(F.col(seconds) >= 0, F.col(seconds))
    return scan(commands, scope, at, {name: (LAST, asked)}, span=span, inclusive=True).withColumn(name, F.coalesce(name, F.lit(0)))
