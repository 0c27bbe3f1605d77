"""Continuous ingest: files of snapshots stream in, and the fullest snapshot of each session stays.

A transcript is appended to under its old path, which a file stream would not read again; so
the stream reads snapshot copies, each under its own path. Every micro-batch merges its
candidates into a bucketed table by the preferred-snapshot rule, which depends on neither
order nor repetition: late, partial or replayed copies change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..bucketed import BucketedTable
from ..operators.store import preferred


class SnapshotTable:
    """Preferred snapshots by key, in buckets.

    A micro-batch adds a layer to the buckets of its keys and so writes only what it brought;
    the rule is applied again on reading. A bucket of more than ``most`` layers is written
    anew as one, which each of its rows meets once in ``most`` batches.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int | None = None, most: int = 8):
        self.keys, self.most, self.held = keys, most, BucketedTable(spark, folder, keys, buckets)

    def read(self) -> DataFrame | None:
        rows = self.held.read()
        return None if rows is None else preferred(rows, self.keys)

    def merge(self, batch: DataFrame) -> None:
        best = preferred(batch, self.keys)
        if not self.held.exists():
            return self.held.replace(best)
        self.held.append(best)
        self.held.compact(self.most, lambda rows: preferred(rows, self.keys))


def stream_snapshots(
    spark: SparkSession,
    source: str,
    schema: StructType,
    table: SnapshotTable,
    checkpoint: str,
    every: str | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Starts the stream; with ``every`` (such as "10 seconds") it goes on, without it drains what is there and ends."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: table.merge(batch))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def unchanged(before: DataFrame, after: DataFrame, columns: list[str]) -> bool:
    """Whether two versions have the same content, by count and an order-free hash; lets a cycle be skipped."""
    print_ = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return print_(before) == print_(after)
