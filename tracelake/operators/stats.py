"""Rollups, the entity graph and listings of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_source(transcripts: DataFrame) -> DataFrame:
    return transcripts.groupBy("source").agg(
        F.count("*").alias("transcripts"),
        F.sum(F.coalesce("message_count", F.lit(0))).alias("messages"),
        F.sum(F.coalesce("tool_call_count", F.lit(0))).alias("tool_calls")
    )


def store_totals(transcripts: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of counts; each count is an aggregate of one row, so the joins move nothing."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    kinds = transcripts.agg(F.count_distinct("source").alias("sources"), F.count_distinct("project_path").alias("projects"))
    return count(transcripts, "transcripts").crossJoin(count(messages, "messages")).crossJoin(count(calls, "tool_calls")).crossJoin(kinds)


def project_stats(transcripts: DataFrame) -> DataFrame:
    told = transcripts.where("project_path is not null").groupBy("project_path")
    return told.agg(
        F.max("project_name").alias("project_name"),
        F.count("*").alias("transcripts"),
        F.max("started_at").alias("last_started")
    )


def top_projects(transcripts: DataFrame, limit: int = 30) -> DataFrame:
    told = transcripts.groupBy("project_name", "project_path").agg(F.count("*").alias("transcripts"))
    return told.orderBy(F.desc("transcripts"), F.asc_nulls_last("project_path")).limit(limit)


def project_paths(transcripts: DataFrame) -> DataFrame:
    return transcripts.groupBy(
        F.coalesce("project_path", F.lit("(none)")).alias("path"),
        F.coalesce("project_name", "project_path", F.lit("(none)")).alias("label")
    ).agg(F.count("*").alias("transcripts"))


def unknown_sources(transcripts: DataFrame, known: list[str]) -> DataFrame:
    return transcripts.where(~F.col("source").isin(*known)).groupBy("source").agg(F.count("*").alias("transcripts"))


def machine_counts(transcripts: DataFrame) -> DataFrame:
    return transcripts.where("machine is not null and machine <> ''").groupBy("machine").agg(F.count("*").alias("transcripts"))


def machine_rollup(transcripts: DataFrame, machines: DataFrame) -> DataFrame:
    """machine, region, transcripts, first and last seen; machines unknown to the registry stay."""
    told = transcripts.where("machine is not null").groupBy("machine").agg(
        F.count("*").alias("transcripts"),
        F.min("started_at").alias("seen_first"),
        F.max("started_at").alias("seen_last")
    )
    return told.join(machines.select(F.col("name").alias("machine"), "region", "first_seen_at", "last_seen_at"), "machine", "left").select(
        "machine", "region", "transcripts", F.least("seen_first", "first_seen_at").alias("first_seen"), F.greatest("seen_last", "last_seen_at").alias("last_seen")
    )


def edges(transcripts: DataFrame, calls: DataFrame) -> DataFrame:
    """session_id, type, name: the bipartite graph of transcripts and what they touch."""
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("type"), F.col(column).alias("name")) for kind, column in (
                ("project", "project_name"),
                ("model", "model"),
                ("provider", "source"),
                ("machine", "machine")
            )
        ]
    )
    own = transcripts.select(F.col("id").alias("session_id"), F.inline(kinds))
    tools = calls.select("session_id", F.lit("tool").alias("type"), F.col("tool_name").alias("name"))
    return own.unionByName(tools).where("name is not null and name <> ''").distinct()


def entities(transcripts: DataFrame, calls: DataFrame) -> DataFrame:
    return edges(transcripts, calls).groupBy("type", "name").agg(F.count("*").alias("transcripts"))


def related_transcripts(transcripts: DataFrame, calls: DataFrame, wanted: DataFrame, limit: int = 50) -> DataFrame:
    """For each wanted (type, name): its transcripts, newest first."""
    found = edges(transcripts, calls).join(wanted, ["type", "name"]).join(
        transcripts.select(F.col("id").alias("session_id"), "started_at"),
        "session_id"
    )
    order = W.partitionBy("type", "name").orderBy(F.desc("started_at"), "session_id")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def neighborhood(transcripts: DataFrame, calls: DataFrame) -> DataFrame:
    """Each session's project, model, provider, machine and sorted tools."""
    tools = calls.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_set("tool_name")), ",").alias("tools"))
    return transcripts.join(tools, transcripts["id"] == tools["session_id"], "left").select(
        "id",
        "project_name",
        "model",
        F.col("source").alias("provider"),
        "machine",
        F.coalesce("tools", F.lit("")).alias("tools")
    )


def recency(*more: str) -> list[Column]:
    return [F.desc_nulls_last("started_at"), *[F.col(c) for c in more], F.col("id")]


def list_transcripts(transcripts: DataFrame, where: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, with an id tie-break."""
    told = transcripts if where is None else transcripts.where(where)
    return told.orderBy(*recency()).offset(offset).limit(limit)


def in_project(project: str) -> Column:
    """Equal path or name, or either contains it, whatever its case; wildcards are literal."""
    plain = project.lower()
    holds = lambda c: F.coalesce(F.lower(F.col(c)).contains(plain), F.lit(False))
    return (F.col("project_path") == project) | (F.col("project_name") == project) | holds("project_path") | holds("project_name")


def history(transcripts: DataFrame, needle: str | None = None, day: str | None = None, limit: int = 200) -> DataFrame:
    """The latest ``limit`` transcripts, and of those the ones of a day or with a needle in source, title or model."""
    told = list_transcripts(transcripts, limit=limit)
    if day:
        told = told.where(F.col("started_at").startswith(day))
    if needle:
        told = told.where(F.lower(F.concat_ws(" ", "source", "title", "model")).contains(needle.lower()))
    return told


def latest_per_project(transcripts: DataFrame) -> DataFrame:
    order = W.partitionBy("project_path").orderBy(*recency())
    return transcripts.where("project_path is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def session_detail(transcripts: DataFrame, messages: DataFrame, first: int = 12) -> DataFrame:
    """Each session with its first ``first`` messages in order."""
    order = W.partitionBy("session_id").orderBy("sequence_num", "id")
    own = messages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    return own.join(transcripts.select(F.col("id").alias("session_id"), "title", "source"), "session_id")


def resolve_identifiers(transcripts: DataFrame, wanted: DataFrame, most: int = 6) -> DataFrame:
    """identifier, status (unique, ambiguous, missing, invalid), level, matches, candidates.

    Rules in order, the first that matches counts: exact id, exact source:id, source:prefix of
    the native id, exact native id, prefix of either id. Only equal-length prefixes of what is
    asked are joined, so nothing is compared with everything; lengths beyond the longest id
    are left out, for no prefix has them.
    """
    asked = wanted.select("identifier").distinct().withColumn("want", F.trim("identifier"))
    own = transcripts.select("id", "source", "source_id")
    lengths = asked.where("want <> ''").select(F.length(F.substring_index("want", ":", -1)).alias("len")).distinct()
    exact = own.select("id", F.lit(1).alias("level"), F.col("id").alias("want"))
    exact = exact.unionByName(own.select("id", F.lit(2).alias("level"), F.concat_ws(":", "source", "source_id").alias("want")))
    exact = exact.unionByName(own.select("id", F.lit(4).alias("level"), F.col("source_id").alias("want")))
    longest = own.agg(F.max(F.greatest(F.length("id"), F.length("source_id"))).alias("longest"))
    typed = lengths.join(longest, F.col("len").between(1, F.col("longest"))).agg(F.collect_set("len").alias("lens"))
    # one row, of an array no longer than the longest id: the lengths that somebody typed
    cut = own.crossJoin(F.broadcast(typed)).withColumn("len", F.explode("lens")).drop("lens")
    native = cut.where(F.length("source_id") >= F.col("len"))
    prefix = native.select("id", F.lit(3).alias("level"), F.concat_ws(":", "source", F.expr("left(source_id, len)")).alias("want"))
    prefix = prefix.unionByName(native.select("id", F.lit(5).alias("level"), F.expr("left(source_id, len)").alias("want")))
    prefix = prefix.unionByName(
        cut.where(F.length("id") >= F.col("len")).select("id", F.lit(5).alias("level"), F.expr("left(id, len)").alias("want"))
    )
    found = exact.unionByName(prefix).join(asked, "want").select("identifier", "level", "id").distinct()
    least = found.withColumn("best", F.min("level").over(W.partitionBy("identifier"))).where("level = best")
    told = least.groupBy("identifier").agg(
        F.min("level").alias("level"),
        F.count("*").alias("matches"),
        F.array_join(F.slice(F.sort_array(F.collect_set("id")), 1, most), ",").alias("candidates")
    )
    status = F.when(F.col("want") == "", "invalid").when(
        F.col("matches").isNull(),
        "missing"
    ).when(F.col("matches") > 1, "ambiguous").otherwise("unique")
    return asked.join(told, "identifier", "left").select(
        "identifier",
        status.alias("status"),
        "level",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.coalesce("candidates", F.lit("")).alias("candidates")
    )
