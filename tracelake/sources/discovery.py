"""Discovery of transcript files: folders by date, of which only the days asked for are listed, and project folders.

Files are found through Spark's own listing, so any store that Spark reads will do; of a
file only its path, time and size are read.
"""

from __future__ import annotations

import datetime as dt
from calendar import monthrange

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import numbered

SNAPSHOT = "path string, mtime timestamp, size long"


def day_globs(first: dt.date, last: dt.date) -> list[str]:
    """Patterns of YYYY/MM/DD folders for all days of a range: whole years and months by one pattern each."""
    out, day = [], first
    while day <= last:
        if day.month == day.day == 1 and dt.date(day.year, 12, 31) <= last:
            out.append(f"{day:%Y}/*/*")
            day = dt.date(day.year + 1, 1, 1)
            continue
        end = day.replace(day=monthrange(day.year, day.month)[1])
        if day.day == 1 and end <= last:
            out.append(f"{day:%Y/%m}/*")
            day = end + dt.timedelta(days=1)
            continue
        out.append(f"{day:%Y/%m/%d}")
        day += dt.timedelta(days=1)
    return out


def _paths(root: str, first: dt.date | None, last: dt.date | None, pattern: str) -> str:
    days = ["*/*/*"] if first is None and last is None else day_globs(
        first or dt.date(1970, 1, 1),
        last or dt.date(dt.date.today().year + 1, 12, 31)
    )
    return f"{root}/{days[0]}/{pattern}" if len(days) == 1 else f"{root}/{{{','.join(days)}}}/{pattern}"


def _loaded(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The files that a pattern names; none, and no error, where it names none."""
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    found = _loaded(spark, path, "binaryFile", "path string, modificationTime timestamp, length long, content binary")
    return found.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def dated(spark: SparkSession, root: str, first: dt.date | None = None, last: dt.date | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """path, day, mtime, size of the files in the folders YYYY/MM/DD from ``first`` to ``last``; other days aren't listed."""
    found = _listed(spark, _paths(root, first, last, pattern))
    return found.withColumn("day", F.to_date(F.regexp_extract("path", r"/(\d{4}/\d{2}/\d{2})/[^/]*$", 1), "yyyy/MM/dd"))


def dated_lines(
    spark: SparkSession, root: str, first: dt.date | None = None, last: dt.date | None = None, pattern: str = "*.jsonl"
) -> DataFrame:
    """file, ord, value of every line of the files of those days; no other file is opened."""
    path = _paths(root, first, last, pattern)
    try:
        return numbered(spark.read.text(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, ord int, value string")


def projects(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, folder, parent, mtime, size of the transcripts in project folders and one level below them.

    A file right in a project's folder has no parent; one in a folder within it, a
    subagent's, has that folder's name. What lies deeper is no transcript.
    """
    near, below = _listed(spark, f"{root}/*/{pattern}"), _listed(spark, f"{root}/*/*/{pattern}")
    part = lambda k: F.element_at(F.split("path", "/"), k)
    told = near.withColumn("folder", part(-2)).withColumn("parent", F.lit(None).cast("string"))
    return told.unionByName(below.withColumn("folder", part(-3)).withColumn("parent", part(-2)))


def signatures(spark: SparkSession, side_files: dict[str, str]) -> DataFrame:
    """source, signature (mtime and size) of the side file that each source is read with; null where it is missing."""
    told = None
    for source, path in side_files.items():
        mark = F.concat_ws(":", F.unix_micros("mtime").cast("string"), F.col("size").cast("string"))
        one = _listed(spark, path).agg(F.max(mark).alias("signature")).select(F.lit(source).alias("source"), "signature")
        told = one if told is None else told.unionByName(one)
    return spark.createDataFrame([], "source string, signature string") if told is None else told


def signed(files: DataFrame, marks: DataFrame) -> DataFrame:
    """Files (source, path, mtime, size) with the ``signature`` of their source, for ``file_gate`` and the stored state."""
    return files.join(marks, "source", "left")
