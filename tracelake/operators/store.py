"""Store maintenance as table functions: upserts, snapshots, merges, rewrites, exports, backfill and ingest gates.

A store is a set of tables; each function returns the new table, for the caller to write as
a new version. Keys are joined, never collected.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import resolve_identifiers


def upserted(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """``old`` with ``new`` merged by natural key; of a known row the ``kept`` columns stay, other values that are not null win."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    pick = lambda c: (("o", "n") if c in kept else ("n", "o"))
    return joined.select(*[F.coalesce(*[F.col(f"{side}.{c}") for side in pick(c)]).alias(c) for c in old.columns])


def children_replaced(children: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Children of the parents that ``incoming`` touches are replaced by it."""
    return children.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def preferred(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's snapshots the one with most messages and tool calls, then messages, then latest mtime, then path.

    Grouped by max_by, so it combines before the shuffle and does not depend on order.
    """
    order = F.struct(F.col("messages") + F.col("tool_calls"), "messages", "mtime", "path")
    rest = [c for c in snapshots.columns if c not in keys]
    best = snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, "best.*")


def shrink_verdicts(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """key, verdict: a replacement with fewer messages or tool calls is refused unless intent and reason are given."""
    joined = incoming.alias("i").join(stored.alias("s"), key, "left")
    fewer = (F.col("i.messages") < F.col("s.messages")) | (F.col("i.tool_calls") < F.col("s.tool_calls"))
    meant = F.coalesce(F.col("i.intent"), F.lit(False)) & (F.coalesce(F.trim("i.reason"), F.lit("")) != "")
    verdict = F.when(F.col("s.messages").isNull(), "new").when(~fewer, "accept").when(meant, "accept_shrink").otherwise("refuse")
    return joined.select(key, verdict.alias("verdict"))


def merged_stores(target: DataFrame, source: DataFrame) -> DataFrame:
    """Transcripts of both stores; of the source only those with new id and new natural key come in."""
    new = source.join(target.select("id"), "id", "left_anti").join(
        target.select("source", "source_id"),
        ["source", "source_id"],
        "left_anti"
    )
    return target.withColumn("origin", F.lit("target")).unionByName(new.select(target.columns).withColumn("origin", F.lit("source")))


def merged_children(target_transcripts: DataFrame, source_transcripts: DataFrame, children: DataFrame) -> DataFrame:
    """The source's children under the ids that survive: those of ignored parents move to the known session's id."""
    ids = source_transcripts.alias("s").join(target_transcripts.alias("t"), ["source", "source_id"], "left").select(
        F.col("s.id").alias("session_id"),
        F.coalesce("t.id", "s.id").alias("_id")
    )
    return children.join(ids, "session_id").withColumn("session_id", F.col("_id")).drop("_id")


def register_machines(seen: DataFrame) -> DataFrame:
    return seen.groupBy("name").agg(
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
        F.count("*").alias("session_count")
    )


def machines_recounted(machines: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The registry with the transcripts that each machine has now; a machine that it lacks comes in, one that has none keeps its count."""
    now = transcripts.where(F.coalesce("machine", F.lit("")) != "").groupBy(F.col("machine").alias("name")).agg(F.count("*").alias("_n"))
    told = machines.join(now, "name", "full").withColumn("session_count", F.coalesce("_n", "session_count"))
    return told.select(machines.columns)


#: Token totals of a transcript, and the message columns that they sum.
TOTALS = {
    "total_input_tokens": "input_tokens", "total_output_tokens": "output_tokens", "total_cache_read_tokens": "cache_read_tokens", "total_cache_write_tokens": "cache_write_tokens"
}


def recounted(transcripts: DataFrame, messages: DataFrame, calls: DataFrame, touched: DataFrame) -> DataFrame:
    """The transcripts, those in ``touched`` with the counts and totals of their children.

    ``touched`` has an id, and may have totals of its own: one that isn't null wins over the
    sum. Only the children of touched transcripts are read for it; others keep what they have.
    """
    ids = touched.select(F.col("id").alias("session_id"))
    sums = {t: c for t, c in TOTALS.items() if t in transcripts.columns and c in messages.columns}
    own = messages.join(ids, "session_id", "left_semi").groupBy("session_id").agg(
        F.count("*").alias("_messages"),
        *[F.sum(c).alias(f"_{t}") for t, c in sums.items()]
    )
    used = calls.join(ids, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("_calls"))
    told = touched.select(F.col("id").alias("session_id"), *[F.col(t).alias(f"_own_{t}") for t in sums if t in touched.columns])
    told = told.join(own, "session_id", "left").join(used, "session_id", "left").withColumn("_touched", F.lit(True))
    joined = transcripts.join(told.withColumnRenamed("session_id", "id"), "id", "left")
    fresh = {"message_count": F.coalesce("_messages", F.lit(0)), "tool_call_count": F.coalesce("_calls", F.lit(0))}
    for total in sums:
        given = [F.col(f"_own_{total}")] if total in touched.columns else []
        fresh[total] = F.coalesce(*given, F.col(f"_{total}"), F.lit(0))
    types = dict(transcripts.dtypes)
    return joined.select(
        *[
            F.when(F.col("_touched"), fresh[c]).otherwise(F.col(c)).cast(types[c]).alias(c) if c in fresh else F.col(c) for c in transcripts.columns
        ]
    )


def without_known(target: DataFrame, source: DataFrame, *keys: list[str]) -> DataFrame:
    """Rows of ``source`` that are new by each of the keys; a key with a null is never known."""
    for key in keys:
        source = source.join(target.select(*key).where(" and ".join(f"{k} is not null" for k in key)).distinct(), key, "left_anti")
    return source


def stores_merged(target: dict[str, DataFrame], source: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables of the merged store, rows added to each): transcripts, messages, tool_calls and, where both have them, embeddings.

    A row of the source comes in unless its id or its natural key is known; those of a
    transcript that was known under another id come in under that. Machine tags stay as
    they are; the registry of machines is recounted.
    """
    natural = {
        "transcripts": ["source", "source_id"], "messages": ["session_id", "source_id"], "tool_calls": None, "embeddings": ["message_id", "chunk_index"]
    }
    added: dict[str, DataFrame] = {}
    for name, key in natural.items():
        if name in target and name in source:
            rows = source[name] if name == "transcripts" else merged_children(target["transcripts"], source["transcripts"], source[name])
            added[name] = without_known(target[name], rows, ["id"], *([key] if key else [])).select(target[name].columns)
    merged = {name: target[name].unionByName(rows) for name, rows in added.items()}
    if "machines" in target:
        merged["machines"] = machines_recounted(target["machines"], merged["transcripts"])
    return merged, added


def merge_report(added: dict[str, DataFrame]) -> DataFrame:
    """tab, added: how many rows a merge brought into each table."""
    told = None
    for name, rows in added.items():
        one = rows.agg(F.count("*").alias("added")).select(F.lit(name).alias("tab"), "added")
        told = one if told is None else told.unionByName(one)
    return told


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the transcripts in ``gone`` (session_id)."""
    return {name: df.join(gone.withColumnRenamed("session_id", key), key, "left_anti") for name, (df, key) in tables.items()}


def renamed(transcripts: DataFrame, titles: DataFrame) -> DataFrame:
    """New titles by id; others stay."""
    return transcripts.join(
        titles.select("id", F.col("title").alias("_title")),
        "id",
        "left"
    ).withColumn("title", F.coalesce("_title", "title")).drop("_title")


def renamed_by(transcripts: DataFrame, titles: DataFrame) -> DataFrame:
    """New titles by identifier (id, source:id, or a prefix); an identifier that names several transcripts, or none, changes nothing."""
    told = resolve_identifiers(transcripts, titles.select("identifier")).where("status = 'unique'").select(
        "identifier",
        F.col("candidates").alias("id")
    )
    return renamed(transcripts, told.join(titles, "identifier").groupBy("id").agg(F.min("title").alias("title")))


def remapped_text(text: Column, old: str, new: str, bounded: bool) -> Column:
    """``text`` with ``old`` replaced everywhere or, if ``bounded``, only where a path ends or goes on to a child."""
    if not bounded:
        return F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, re.escape(old) + r"(?=$|[/\s\"'])", new.replace("\\", "\\\\").replace("$", "\\$"))


def matching_folders(folders: DataFrame, path: str) -> DataFrame:
    """Rows whose ``folder`` is the encoded path or a child of it."""
    encoded = path.replace("/", "-")
    return folders.where((F.col("folder") == encoded) | F.col("folder").startswith(encoded + "-"))


def moved(path: Column, old: str, new: str) -> Column:
    """``path`` with the prefix ``old`` replaced, only where it ends at a boundary."""
    return F.when(
        (path == old) | path.startswith(old + "/"),
        F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))
    ).otherwise(path)


def encoded(path: str) -> str:
    return path.replace("/", "-")


def relocated(transcripts: DataFrame, old: str, new: str) -> DataFrame:
    """project_path and source_path moved by prefix, in plain and in path-encoded form."""
    plain = moved(F.col("project_path"), old, new)
    source = F.replace(moved(F.col("source_path"), old, new), F.lit("/" + encoded(old) + "/"), F.lit("/" + encoded(new) + "/"))
    return transcripts.withColumn("project_path", plain).withColumn("source_path", source)


def file_gate(files: DataFrame, state: DataFrame) -> DataFrame:
    """source, path, action: skip files whose state is ok with the same mtime and size, else new, changed or retry.

    Where both tables have a ``signature``, that of the side files that a source is read
    with, it has to be the same too.
    """
    joined = files.alias("f").join(state.alias("s"), ["source", "path"], "left")
    same = (F.col("s.mtime") == F.col("f.mtime")) & (F.col("s.size") == F.col("f.size"))
    if "signature" in files.columns and "signature" in state.columns:
        same = same & F.col("s.signature").eqNullSafe(F.col("f.signature"))
    action = F.when(F.col("s.status").isNull(), "new").when(
        (F.col("s.status") == "ok") & same,
        "skip"
    ).when(F.col("s.status") == "ok", "changed").otherwise("retry")
    return joined.select("source", "path", action.alias("action"))


def latest_state(states: DataFrame) -> DataFrame:
    """The last state of each file: by time, then by run."""
    return states.groupBy("source", "path").agg(
        F.max_by(F.struct("mtime", "size", "status"), F.struct("ingested_at", "run")).alias("s")
    ).select("source", "path", "s.*")


def state_upserted(state: DataFrame, new: DataFrame) -> DataFrame:
    """source, path, mtime, size, status, message, run: the state with a later one of each file in place of its old one."""
    told = state.unionByName(new)
    last = F.max_by(F.struct("mtime", "size", "status", "message", "run"), "run")
    return told.groupBy("source", "path").agg(last.alias("s")).select("source", "path", "s.*")


def deferred(before: DataFrame, after: DataFrame, parsed: DataFrame) -> DataFrame:
    """source, path, mtime, size, status, message of files that were read between two snapshots.

    ``parsed`` (source, path, incomplete, error) tells how reading went. An error is kept with
    its message; a file that vanished, ends in an unfinished record or changed meanwhile is
    pending; only ``ok`` files may be merged, and none holds up the others.
    """
    keys = ["source", "path"]
    told = before.select(*keys, "mtime", "size").join(
        after.select(*keys, F.col("mtime").alias("_mtime"), F.col("size").alias("_size")),
        keys,
        "left"
    ).join(parsed, keys)
    gone = F.col("_mtime").isNull()
    message = F.when(F.col("error").isNotNull(), F.col("error")).when(gone, "file vanished after parsing").when(
        F.col("incomplete"),
        "incomplete trailing record"
    )
    message = message.when(
        ~(F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))),
        "file changed during parsing"
    )
    status = F.when(F.col("error").isNotNull(), "error").when(message.isNotNull(), "pending").otherwise("ok")
    own = F.col("error").isNotNull() | gone
    return told.select(
        *keys,
        F.when(own, F.col("mtime")).otherwise(F.col("_mtime")).alias("mtime"),
        F.when(own, F.col("size")).otherwise(F.col("_size")).alias("size"),
        status.alias("status"),
        message.alias("message")
    )


def watch_status(files: DataFrame, state: DataFrame) -> DataFrame:
    """source, ok, pending, errors, newest_pending for each source."""
    told = file_gate(files, state).join(files, ["source", "path"]).join(
        state.select("source", "path", "status"),
        ["source", "path"],
        "left"
    )
    waits = F.col("action") != "skip"
    return told.groupBy("source").agg(
        F.count_if(~waits).alias("ok"),
        F.count_if(waits).alias("pending"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.max(F.when(waits, F.col("mtime"))).alias("newest_pending")
    )


def ingest_result(gate: DataFrame) -> DataFrame:
    count = lambda *a: F.count_if(F.col("action").isin(*a))
    return gate.groupBy("source").agg(
        F.count("*").alias("scanned"),
        count("new", "changed", "retry").alias("ingested"),
        count("skip").alias("skipped"),
        count("retry").alias("retried")
    )


def index_merged(held: DataFrame, incoming: DataFrame, key: str = "session_id") -> DataFrame:
    """Entries of a project's index after those of a moved project came in: an incoming one of the same key wins."""
    return incoming.unionByName(held.join(incoming.select(key), key, "left_anti"))


def size_estimate(transcripts: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """id, bytes: UTF-8 bytes of a transcript with its messages and tool calls, each as compact JSON, and a line feed after each."""
    said = lambda df, key: df.select(F.col(key).alias("id"), (F.octet_length(F.to_json(F.struct(*df.columns))) + 1).alias("bytes"))
    rows = said(transcripts, "id").unionByName(said(messages, "session_id")).unionByName(said(calls, "session_id"))
    return rows.groupBy("id").agg(F.sum("bytes").alias("bytes")).join(transcripts.select("id"), "id", "left_semi")


def export_manifest(files: DataFrame) -> DataFrame:
    """project, files, bytes, and a total row with project null."""
    return files.rollup("project").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def import_report(incoming: DataFrame, existing: DataFrame, key: str, old: str, new: str, overwrite: bool = False) -> DataFrame:
    """key, path, action: the export's rows under the new prefix; known rows are skipped unless ``overwrite``."""
    told = incoming.join(existing.select(key, F.lit(True).alias("_known")), key, "left")
    path = moved(F.col("path"), old, new)
    action = F.when(F.col("_known") & F.lit(not overwrite), "skipped").when(path != F.col("path"), "remapped").otherwise("imported")
    return told.select(key, path.alias("path"), action.alias("action"))


def inventory(files: DataFrame) -> DataFrame:
    """Files with the first path of their key; later paths are duplicates of it."""
    order = W.partitionBy("key").orderBy("path")
    first = F.first("path").over(order)
    return files.withColumn("duplicate_of", F.when(F.row_number().over(order) > 1, first))


def inventory_summary(files: DataFrame) -> DataFrame:
    single = F.col("duplicate_of").isNull()
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(single).alias("selected"),
        F.count_if(~single).alias("duplicates"),
        F.sum(F.when(single, F.col("bytes"))).alias("bytes"),
        F.max(F.when(single, F.col("bytes"))).alias("largest"),
        F.count_if(F.col("error").isNotNull()).alias("errors")
    )


def selected(
    files: DataFrame, low: str | None = None, high: str | None = None, first: int | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Entries in key order: a range, a pilot of the first few, or known keys; duplicates and errors are left out."""
    told = files.where("duplicate_of is null and error is null")
    if low is not None:
        told = told.where(F.col("key") >= low)
    if high is not None:
        told = told.where(F.col("key") <= high)
    if known is not None:
        told = told.join(known, "key", "left_semi")
    return told if first is None else told.orderBy("key").limit(first)


def capacity(files: DataFrame, most_each: int, most_all: int) -> DataFrame:
    told = files.agg(F.max("bytes").alias("largest"), F.sum("bytes").alias("total"))
    verdict = F.when(F.col("largest") > most_each, "session_too_large").when(F.col("total") > most_all, "total_too_large").otherwise("fits")
    return told.withColumn("verdict", verdict)


def resume_plan(files: DataFrame, checkpoint: DataFrame, stored: DataFrame, provenance: list[str]) -> DataFrame:
    """key, plan: skip what is completed with the same provenance and stored digest, quarantine a mismatch, else pending."""
    joined = files.alias("f").join(checkpoint.alias("c"), "key", "left").join(stored.alias("d"), "key", "left")
    same = F.lit(True)
    for column in provenance:
        same = same & F.col(f"f.{column}").eqNullSafe(F.col(f"c.{column}"))
    agrees = same & F.col("d.stored_digest").eqNullSafe(F.col("c.digest"))
    plan = F.when(F.col("c.state").isNull() | (F.col("c.state") != "completed"), "pending").when(agrees, "skip").otherwise("quarantine")
    return joined.select("key", plan.alias("plan"))


def checkpoint_view(runs: DataFrame) -> DataFrame:
    """key, state, run: the last run of each key counts, earlier ones are superseded."""
    return runs.groupBy("key").agg(F.max_by("state", "run").alias("state"), F.max("run").alias("run"), F.count("*").alias("versions"))


def stale(fresh: DataFrame, chosen: DataFrame, provenance: list[str]) -> DataFrame:
    """key, stale: entries whose provenance is no longer what the inventory said when they were chosen, or that are gone."""
    joined = chosen.alias("c").join(fresh.alias("f"), "key", "left")
    same = F.lit(True)
    for column in provenance:
        same = same & F.col(f"f.{column}").eqNullSafe(F.col(f"c.{column}"))
    return joined.select("key", (~same).alias("stale"))


def readable(runs: DataFrame, version: int) -> DataFrame:
    """Checkpoint rows (key, state, run, version, digest); completed ones of another version count as skipped, without digest."""
    old = (F.col("version") != version) & (F.col("state") == "completed")
    note = F.when(old, F.concat(F.lit("unsupported checkpoint version "), F.col("version").cast("string")))
    return runs.where((F.col("version") == version) | old).select(
        "key",
        F.when(old, "skipped").otherwise(F.col("state")).alias("state"),
        "run",
        F.when(~old, F.col("digest")).alias("digest"),
        note.alias("note")
    )


def checkpoint_written(runs: DataFrame, results: DataFrame, version: int) -> DataFrame:
    """The checkpoint's rows with those of one more run; the last run of a key counts (``checkpoint_view``)."""
    run = F.broadcast(runs.agg((F.coalesce(F.max("run"), F.lit(0)) + 1).alias("run")))
    return runs.unionByName(results.crossJoin(run).select("key", "state", "run", F.lit(version).alias("version"), "digest"))


def not_found(known: DataFrame, files: DataFrame) -> DataFrame:
    return known.join(files.select("key"), "key", "left_anti")


def sync_plan(transcripts: DataFrame, children: DataFrame, limit: int = 500) -> DataFrame:
    """id, stored, loaded, verdict for the newest ``limit`` transcripts: push, or refuse what is empty or short of its count."""
    newest = transcripts.orderBy(F.desc_nulls_last("started_at"), "id").limit(limit)
    loaded = children.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("loaded"))
    told = newest.join(loaded, "id", "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    verdict = F.when(F.col("loaded") == 0, "refuse_empty").when(F.col("loaded") < F.col("message_count"), "refuse_short").otherwise("push")
    return told.select("id", F.col("message_count").alias("stored"), "loaded", verdict.alias("verdict"))
