"""A ledger of deliveries: which file went out, how often it was tried, and when it may be tried again.

A round sends what is due, writes what came of it to `tries/round=N`, and counts once its row is in `ledger/round=N`. Files are deleted by
`sweep` only, from what the ledger holds; a driver lost between sending and sweeping sends nothing again that the ledger has. What was sent in a
round that didn't get that far, or by a task that ran twice, goes out again: at least once, and the receiver replaces by name.
A file is told apart by path and time of change, so a new one under an old name is sent, and is not deleted for the old one's sake.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.files import store
from logweave.sources.push import Uploader, consume, push

FILE = ["path", "mtime"]
TRIES = "path string, mtime timestamp, attempts int, code int, action string, throttle int, next_try timestamp, round bigint"
LEDGER = "rows bigint, base boolean, round bigint"


class Deliveries:
    """first_wait, most_wait: seconds before a failed file's second try, doubled for each further one, and the most of it; the receiver's throttle counts if longer."""

    def __init__(self, spark: SparkSession, path: str, first_wait: float = 1.0, most_wait: float = 3600.0):
        self.spark, self.path, self.first_wait, self.most_wait = spark, path, first_wait, most_wait

    def _read(self, name: str, schema: str) -> DataFrame:
        at, root = store(f"{self.path}/{name}")
        there = at.get_file_info(root).type.name == "Directory"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """(rows, base, round) of the rounds that count; a base stands for all rounds before it."""
        return self._read("ledger", LEDGER)

    def states(self) -> DataFrame:
        """The last try of each file."""
        base = self.ledger().where("base").agg(F.max("round")).first()[0] or 0
        rounds = self.ledger().where(F.col("round") >= base).select("round")
        tries = self._read("tries", TRIES).where(F.col("round") >= base).join(rounds, "round", "left_semi")
        return tries.groupBy(*FILE).agg(F.max_by(F.struct("attempts", "code", "action", "throttle", "next_try", "round"), F.struct("attempts", "round")).alias("_last")).select(*FILE, "_last.*")

    def due(self, listing: DataFrame, now: datetime) -> DataFrame:
        """(path, mtime, attempts so far) of the listed files that the ledger doesn't have, or whose next try has come."""
        both = listing.select(*FILE).join(self.states().select(*FILE, "attempts", "action", "next_try"), FILE, "left")
        may = F.col("action").isNull() | ((F.col("action") == "retry") & (F.col("next_try") <= F.lit(now)))
        return both.where(may).select(*FILE, F.coalesce("attempts", F.lit(0)).alias("attempts"))

    def send(self, listing: DataFrame, folder: str, uploader: Uploader, now: datetime) -> int:
        """One round over a listing (path, mtime) of the folder; returns how many files it tried."""
        queue = self.due(listing, now)
        said = push(self.spark, queue, folder, uploader).drop("body")
        tries = F.col("attempts") + 1
        wait = F.greatest(F.least(F.lit(self.first_wait) * F.pow(F.lit(2.0), F.col("attempts")), F.lit(self.most_wait)), F.coalesce("throttle", F.lit(0)).cast("double"))
        after = F.timestamp_micros(F.unix_micros(F.lit(now)) + (wait * 1_000_000).cast("bigint"))
        return self._commit(said.select(*FILE, tries.alias("attempts"), "code", "action", F.col("throttle").cast("int").alias("throttle"), F.when(F.col("action") == "retry", after).alias("next_try")), False)

    def _commit(self, rows: DataFrame, base: bool) -> int:
        n = 1 + (self.ledger().agg(F.max("round")).first()[0] or 0)
        data = f"{self.path}/tries/round={n}"
        rows.write.mode("overwrite").parquet(data)
        wrote = self.spark.read.schema("attempts int").parquet(data).count()
        self.spark.createDataFrame([(wrote, base)], "rows bigint, base boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/round={n}")
        return wrote

    def sweep(self, listing: DataFrame) -> None:
        """Deletes the listed files that the ledger has as delivered; safe to repeat."""
        consume(listing.select(*FILE).join(self.states().where("action = 'delete'").select(*FILE, "action"), FILE))

    def compact(self, listing: DataFrame) -> int:
        """Writes the states of files that are still listed as a base, so that the ledger is as large as the folder, and deletes the tries before it."""
        kept = self._commit(self.states().drop("round").join(listing.select(*FILE), FILE, "left_semi"), True)
        base = self.ledger().where("base").agg(F.max("round")).first()[0]
        for r in self.ledger().where(F.col("round") < base).select("round").collect():  # a row a round since the start
            at, old = store(f"{self.path}/tries/round={r['round']}")
            if at.get_file_info(old).type.name == "Directory":
                at.delete_dir(old)
        return kept
