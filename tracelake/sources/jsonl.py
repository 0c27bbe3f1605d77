"""Readers of line and array JSON files. Lines keep their order inside a file; bad lines are counted, not fatal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Adds or replaces a reader (spark, path) -> (file, ord, value)."""
    _readers[name] = reader


def reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in _readers:
        raise KeyError(f"no source named {name}; known: {', '.join(sorted(_readers))}")
    return _readers[name]


def names() -> list[str]:
    return sorted(_readers)


def lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """file, ord, value of every line of the files below a folder."""
    return numbered(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path))


def numbered(raw: DataFrame, *more: str) -> DataFrame:
    """file, ord, value of a text scan, and ``more`` of its columns; lines are numbered straight after it, with no shuffle between."""
    raw = raw.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
        *more
    )
    order = W.partitionBy("_path").orderBy("_block", "_row")
    return raw.withColumn("ord", F.row_number().over(order) - 1).select(F.col("_path").alias("file"), "ord", "value", *more)


def snapshots(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, mtime, size of the files under a folder, for change detection."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def arrays(spark: SparkSession, path: str, pattern: str = "logs.json") -> DataFrame:
    """file, value of whole files that hold one JSON array."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), "value")


def accounting(records: DataFrame, cap: int = 64 << 20) -> DataFrame:
    """file, records, malformed, incomplete_tail, largest, oversized from (file, ord, value)."""
    bad = F.try_parse_json("value").isNull() & (F.trim("value") != "")
    told = records.withColumn("bad", bad).groupBy("file").agg(
        F.count("*").alias("records"), F.count_if("bad").alias("malformed"), F.max_by("bad", "ord").alias("incomplete_tail"), F.max(F.octet_length("value")).alias("largest")
    )
    return told.withColumn("oversized", F.col("largest") > cap)


register("project", lambda spark, path: lines(spark, path))
register("rollout", lambda spark, path: lines(spark, path, "rollout-*.jsonl"))
