"""Runs of streams as a log, and bounded sync cycles that push only what changed.

A cycle looks at the newest transcripts only, a fixed number, and so costs the same however
large the store is. Its signature, a count and an order-free hash, is kept beside the
stream's checkpoint; a cycle whose signature is the last one pushes nothing, also after a
restart.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.watch import RUNS

NEWEST = 500


class RunLog(StreamingQueryListener):
    """Attempts of named streaming queries, a row for each micro-batch and for each end by an error.

    The log holds the last ``most`` rows; ``table`` gives them with the columns of RUNS.
    """

    def __init__(self, most: int = 10_000):
        self.rows, self.most, self.names = [], most, {}

    def note(
        self, source: str, attempted_at: datetime, completed_at: datetime | None, skipped: int = 0, failed: int = 0, error: str | None = None
    ) -> None:
        self.rows = [*self.rows[1 - self.most :], (source, attempted_at, completed_at, skipped, failed, error)]

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        told = event.progress
        began = datetime.fromisoformat(told.timestamp.replace("Z", "+00:00"))
        self.note(told.name or str(told.id), began, datetime.now(UTC))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.note(self.names.get(str(event.id), str(event.id)), datetime.now(UTC), None, error=event.exception.splitlines()[0])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), RUNS)


def signature(rows: DataFrame) -> tuple[int, str]:
    """How many rows, and a hash that neither their order nor how they are dealt changes."""
    told = rows.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string").alias("h")
    ).first()
    return told["n"], told["h"] or ""


class BoundedSync:
    """Cycles over the newest rows of a table, which ``push`` gets when they changed since the last cycle that pushed."""

    def __init__(
        self, spark: SparkSession, read: Callable[[], DataFrame], push: Callable[[DataFrame], None], folder: str, newest: int = NEWEST
    ):
        self.spark, self.read, self.push, self.folder, self.newest = spark, read, push, folder, newest

    def last(self) -> tuple[int, str] | None:
        """The signature of the last cycle that pushed."""
        try:
            row = self.spark.read.schema("cycle long, n long, h string").json(f"{self.folder}/signatures").orderBy(F.desc("cycle")).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return None if row is None else (row["n"], row["h"])

    def cycle(self, number: int) -> bool:
        """One cycle; whether it pushed. The signature is stored after the push: one that fails is tried again."""
        rows = self.read().orderBy(F.desc_nulls_last("started_at"), "id").limit(self.newest).cache()
        try:
            now = signature(rows)
            if now == self.last():
                return False
            self.push(rows)
            told = self.spark.createDataFrame([(number, *now)], "cycle long, n long, h string")
            told.coalesce(1).write.mode("append").json(f"{self.folder}/signatures")
            return True
        finally:
            rows.unpersist()

    def stream(self, changes: DataFrame, every: str | None = None, name: str = "sync") -> StreamingQuery:
        """A cycle for every micro-batch of a stream of change events; without ``every`` what is there is worked off."""
        writer = changes.writeStream.queryName(name).option("checkpointLocation", f"{self.folder}/checkpoint")
        writer = writer.foreachBatch(lambda batch, number: self.cycle(number) and None)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
