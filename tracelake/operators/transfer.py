"""Exports of transcript files that write, and imports that bring them back under another path.

An export is a folder: ``projects/project=…/file=…`` holds each file's lines in their order,
written by one partitioned write, and ``manifest`` one row a project and one, without a
project, for all. Sizes come from the listing of what was written, so that the manifest
tells of the files on disk and nothing is read twice.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.jsonl import numbered
from .materialize import materialized


def export(records: DataFrame, folder: str, projects: DataFrame | None = None) -> DataFrame:
    """Writes records (project, file, ord, value), of the given ``projects`` (project) or of all; returns the manifest."""
    chosen = records if projects is None else records.join(projects.select("project").distinct(), "project", "left_semi")
    told = chosen.select("project", "file", "ord", "value").repartition("project", "file").sortWithinPartitions("project", "file", "ord")
    told.select("project", "file", "value").write.partitionBy("project", "file").text(f"{folder}/projects")
    manifest(records.sparkSession, folder).coalesce(1).write.json(f"{folder}/manifest", ignoreNullFields=False)
    return records.sparkSession.read.schema("project string, files long, bytes long").json(f"{folder}/manifest")


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """project, file, bytes of the files of an export, by its listing."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/projects").select("path", "length")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "path string, length long")
    # folders' values are escaped by per cent; a plus stands for itself
    part = lambda key: F.url_decode(F.replace(F.regexp_extract("path", rf"/{key}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    return found.groupBy(part("project").alias("project"), part("file").alias("file")).agg(F.sum("length").alias("bytes"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """project, files, bytes of an export; the row without a project is the total."""
    return files_of(spark, folder).rollup("project").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


#: A cwd as a key of the record's tree: within a string both its quotes would be escaped.
_CWD = r'("cwd"\s*:\s*")'


def cwd_moved(line: Column, old: str, new: str) -> Column:
    """A JSON line with the prefix ``old`` of every cwd in its tree replaced, only where it ends at a boundary."""
    quoted = lambda path: path.replace("\\", "\\\\").replace('"', '\\"')
    said = quoted(new).replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(line, _CWD + re.escape(quoted(old)) + r'(?=["/])', "$1" + said)


def imported(
    spark: SparkSession, folder: str, existing: DataFrame, old: str = "", new: str = "", overwrite: bool = False, holding: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records to store, quarantined lines, report) of an export; nothing of the store is changed here.

    Records are (project, file, ord, value), with projects and cwd fields moved from ``old``
    to ``new``; with ``holding``, only of projects whose name holds it, in any case. A file that ``existing`` (project, file) has is skipped unless ``overwrite``.
    Lines that are no JSON object are quarantined, the rest of their file comes in. The report
    has project, file, action (imported, remapped, overwritten or skipped), lines and bad lines.
    """
    raw = spark.read.schema(
        "value string, project string, file string"
    ).text(f"{folder}/projects").withColumnsRenamed({"project": "_project", "file": "_file"})
    raw = raw.where(F.contains(F.lower("_project"), F.lit(holding.lower()))) if holding else raw
    told = numbered(raw, "_project", "_file").select("_project", F.col("_file").alias("file"), "ord", F.col("value").alias("_line"))
    to = moved_folder(F.col("_project"), old, new) if old else F.col("_project")
    told = told.withColumn("project", to).withColumn("value", cwd_moved(F.col("_line"), old, new) if old else F.col("_line"))
    told = told.join(existing.select("project", "file", F.lit(True).alias("_known")).distinct(), ["project", "file"], "left")
    known = F.coalesce("_known", F.lit(False))
    action = F.when(known & F.lit(not overwrite), "skipped").when(known, "overwritten").when(
        F.col("project") != F.col("_project"),
        "remapped"
    ).otherwise("imported")
    bad = ~F.coalesce(F.schema_of_variant(F.try_parse_json("_line")).startswith("OBJECT"), F.lit(False))
    told = materialized(told.select("project", "file", "ord", "value", action.alias("action"), bad.alias("bad")))
    report = told.groupBy("project", "file", "action").agg(F.count("*").alias("lines"), F.count_if("bad").alias("bad_lines"))
    kept = told.where("action <> 'skipped'")
    return kept.where("not bad").select(
        "project",
        "file",
        "ord",
        "value"
    ), kept.where("bad").select("project", "file", "ord", "value"), report


def moved_folder(folder: Column, old: str, new: str) -> Column:
    """An encoded project folder with the encoded prefix ``old`` replaced, only where a path's name ends."""
    was, now = old.replace("/", "-"), new.replace("/", "-")
    return F.when(
        (folder == was) | folder.startswith(was + "-"),
        F.concat(F.lit(now), F.substr(folder, F.lit(len(was) + 1)))
    ).otherwise(folder)


def with_verdicts(rows: DataFrame, key: list[str], error: str = "error") -> DataFrame:
    """Rows (key…, error) of whole payloads: key, faults, first fault, accepted; one fault refuses a whole payload."""
    told = rows.groupBy(*key).agg(F.count(F.col(error)).alias("faults"), F.min(error).alias("fault"))
    return told.withColumn("accepted", F.col("faults") == 0)


def content_imported(
    store: dict[str, DataFrame], payload: dict[str, DataFrame], errors: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after the import, report): accepted payloads replace their transcript and its children, refused ones change nothing.

    ``store`` and ``payload`` have transcripts (id, …), messages and tool_calls (session_id, …);
    ``errors`` has (id, error) for every row of a payload, null where it is good.
    """
    verdicts = with_verdicts(errors, ["id"])
    good = verdicts.where("accepted").select("id")
    children = good.withColumnRenamed("id", "session_id")
    out = {"transcripts": _replaced(store["transcripts"], payload["transcripts"], good, "id")}
    for name in ("messages", "tool_calls"):
        out[name] = _replaced(store[name], payload[name], children, "session_id")
    return out, verdicts


def _replaced(held: DataFrame, incoming: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return held.join(keys, key, "left_anti").unionByName(incoming.join(keys, key, "left_semi").select(held.columns))
