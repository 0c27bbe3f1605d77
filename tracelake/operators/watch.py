"""Status of continuous ingest: when each source was last tried and with what success, and how far it lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import file_gate

#: A log of runs: one row for each attempt at a source; ``error`` is null for those that went well.
RUNS = "source string, attempted_at timestamp, completed_at timestamp, skipped long, failed long, error string"


def last_runs(runs: DataFrame) -> DataFrame:
    """source, last_attempt_at, last_success_at, skipped_files, last_error.

    The error is that of the last attempt, or how many files failed where it has no message;
    an attempt that ended well has none. Skipped files are those of the last attempt that ended.
    """
    failed = F.coalesce("failed", F.lit(0))
    said = F.when(failed > 0, F.concat(failed.cast("string"), F.when(failed == 1, " file").otherwise(" files"), F.lit(" failed to ingest")))
    ended = F.when(F.col("completed_at").isNotNull(), F.col("attempted_at"))
    well = F.col("error").isNull() & (failed == 0)
    return runs.groupBy("source").agg(
        F.max("attempted_at").alias("last_attempt_at"),
        F.max(F.when(well, F.col("completed_at"))).alias("last_success_at"),
        F.coalesce(F.max_by(F.coalesce("skipped", F.lit(0)), ended), F.lit(0)).alias("skipped_files"),
        F.max_by(F.struct(F.coalesce("error", said).alias("e")), "attempted_at")["e"].alias("last_error"),
    )


def lag_seconds(newest_pending: Column, now: Column) -> Column:
    """Whole seconds since the newest file that waits was written; 0 where none waits."""
    seconds = lambda t: t.cast("timestamp").cast("double")
    passed = F.floor(seconds(now) - seconds(newest_pending)).cast("long")
    return F.when(newest_pending.isNull(), 0).otherwise(F.greatest(passed, F.lit(0)))


def status(files: DataFrame, state: DataFrame, runs: DataFrame, now: Column | None = None) -> DataFrame:
    """source, ok, pending, lag_seconds, and last_runs' columns, of every source that has files or was tried.

    ``files`` have an mtime of type timestamp; a source without files lags null seconds.
    """
    gate = file_gate(files, state).join(files.select("source", "path", "mtime"), ["source", "path"])
    waits = F.col("action") != "skip"
    told = gate.groupBy("source").agg(
        F.count_if(~waits).alias("ok"),
        F.count_if(waits).alias("pending"),
        F.max(F.when(waits, F.col("mtime"))).alias("_newest")
    )
    told = told.withColumn("lag_seconds", lag_seconds(F.col("_newest"), F.current_timestamp() if now is None else now)).drop("_newest")
    out = told.join(last_runs(runs), "source", "full")
    return out.withColumn("skipped_files", F.coalesce("skipped_files", F.lit(0)))
