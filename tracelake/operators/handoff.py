"""What one agent hands to the next: last turns, a summary, references to credentials by name, commands that were run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .recall import json_values

TURNS, TURN_LENGTH, COMMANDS = 8, 200, 16
#: Keys that hold a command, tools whose input is one, what a secret-like reference becomes, agents' other names.
COMMAND_KEYS = ["command", "cmd", "shell", "script"]
COMMAND_TOOLS = r"(?i)^(bash|shell|terminal|run_command|exec|command)$"
REDACTED_REFERENCE = "[REDACTED_AUTH_REF]"
WARNING = "secret-like auth reference was redacted; pass auth refs by name only"


def recent_turns(messages: DataFrame, most: int = TURNS, length: int = TURN_LENGTH) -> DataFrame:
    """session_id, n, role, text: the last turns of each session, the latest first, redacted, white space collapsed, cut."""
    order = W.partitionBy("session_id").orderBy(F.desc("sequence_num"))
    told = messages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return told.select("session_id", "n", "role", F.substring(T.collapsed(T.redacted("content")), 1, length).alias("text"))


def context_summary(messages: DataFrame, fallback: str = "no user turn") -> DataFrame:
    """session_id, summary: the last user turn of each session, redacted, as a title; else ``fallback``."""
    said = F.when(F.col("role") == "user", F.col("sequence_num"))
    told = messages.groupBy("session_id").agg(F.max_by("content", said).alias("last"))
    return told.select("session_id", F.coalesce(T.session_title(T.redacted("last")), F.lit(fallback)).alias("summary"))


def auth_references(given: DataFrame, key: str, names: dict[str, str] | None = None) -> DataFrame:
    """key, pos, agent, name, warning: references ``agent:name`` of each key, once each, in order of ``pos``.

    Without a colon the agent is unknown. A reference that redaction would change is replaced
    by a mark and warned of, so that no secret goes on. Agents are lower-cased, and called
    by the value of ``names`` where they have another.
    """
    raw = T.trimmed("reference")
    safe = F.when(T.redacted(raw) == raw, raw).otherwise(REDACTED_REFERENCE)
    told = given.where(raw != "").withColumn("_safe", safe)
    at = F.instr("_safe", ":")
    told = told.withColumn("_agent", F.when(at > 0, F.substr("_safe", F.lit(1), at - 1)).otherwise("unknown"))
    told = told.withColumn("name", F.when(at > 0, F.substr("_safe", at + 1)).otherwise(F.col("_safe"))).where("name <> ''")
    once = told.groupBy(key, "_agent", "name").agg(F.min("pos").alias("pos"))
    agent = F.lower(F.trim("_agent"))
    for other, name in (names or {}).items():
        agent = F.when(F.lower(F.trim("_agent")) == other, name).otherwise(agent)
    return once.select(key, "pos", agent.alias("agent"), "name", F.when(F.col("name") == REDACTED_REFERENCE, WARNING).alias("warning"))


def commands(calls: DataFrame, most: int = COMMANDS) -> DataFrame:
    """session_id, pos, command: commands of each session, once each: values under command keys at any depth of a call's
    input or output, then the inputs of command-like tools; at most ``most``, in order of call and place."""
    named = rf'"(?:{"|".join(COMMAND_KEYS)})"'
    texts = calls.select(
        "session_id",
        F.col("id"),
        F.coalesce("timestamp", F.lit("")).alias("at"),
        F.explode(F.array("tool_input", "tool_output")).alias("json")
    ).where(F.col("json").rlike(named))
    keyed = json_values(texts, "json").where(F.col("key").isin(COMMAND_KEYS))
    plain = calls.where(F.col("tool_name").rlike(COMMAND_TOOLS)).select(
        "session_id",
        "id",
        F.coalesce("timestamp", F.lit("")).alias("at"),
        F.col("tool_input").alias("value")
    )
    rows = keyed.select("session_id", F.lit(0).alias("kind"), "at", "id", "path", _line("value")).unionByName(
        plain.select("session_id", F.lit(1).alias("kind"), "at", "id", F.lit("").alias("path"), _line("value"))
    )
    order = F.struct("kind", "at", "id", "path")
    once = rows.where("command is not null").groupBy("session_id", "command").agg(F.min(order).alias("order"))
    told = once.withColumn("pos", F.row_number().over(W.partitionBy("session_id").orderBy("order", "command")))
    return told.where(F.col("pos") <= most).select("session_id", "pos", "command")


def _line(value: str) -> Column:
    return T.command_line(value).alias("command")
