"""Sharding through fixed virtual slots.

Method: a record's doc_id is hashed to one of ``SLOTS`` slots, which never change. A small
stored map (version, slot, shard) says where each slot lives; version 1 deals the slots
out in turn. The bytes of each slot are aggregated, and rebalancing edits the map: single
slots move from the heaviest shard to the lightest, the rows of all other slots stay where
they are, and the edited map is stored as the next version. Rows go by the latest version.
Only the map, of ``SLOTS`` rows, passes through the driver.

A record's id decides its slot, not its text: equal texts under several ids are records
like others and may lie in several shards, as the law of near-equal bytes asks of a text
that a third of all rows share.

Results by case: a null text has 0 bytes and the crc32 of the empty string; a row with a
null doc_id is hashed by its text; repeated rows, of one id (or none) and one text, are
counted before they are dealt, and every ``RUN`` of them go to a slot of their own, so that
any number of them spreads over all shards; ties in size go to the smaller slot and shard number; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import checkpoint_folder, checkpointed

SLOTS = 8192
SHARDS = 24
OVERHEAD = 8

#: Repeated rows that stay together, and runs of them that one array holds while they are made.
RUN, RUNS_AT_ONCE = 16, 4096


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def dealt_in_turn(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """slot -> shard before any sizes are known."""
    return {slot: slot % shards for slot in range(slots)}


def rebalanced(where: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.001) -> dict[int, int]:
    """The map edited for new sizes or more shards: slots leave the heaviest shard for the lightest
    until all are within ``tolerance`` of the mean or no single move helps; others stay."""
    where = dict(where)
    loads = [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in sorted(where.items()):
        loads[shard] += sizes.get(slot, 0)
        own[shard].append((sizes.get(slot, 0), slot))
    mean = sum(loads) / shards
    while True:
        most, least = max(range(shards), key=lambda k: (loads[k], -k)), min(range(shards), key=lambda k: (loads[k], k))
        gap = loads[most] - loads[least]
        if max(loads[most] - mean, mean - loads[least]) <= tolerance * mean:
            return where
        fits = [x for x in own[most] if 0 < x[0] < gap]
        if not fits:
            return where
        size, slot = min(fits, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        own[most].remove((size, slot))
        own[least].append((size, slot))
        loads[most] -= size
        loads[least] += size
        where[slot] = least


def map_frame(spark: SparkSession, where: dict[int, int], version: int) -> DataFrame:
    rows = [(version, slot, shard) for slot, shard in sorted(where.items())]
    return spark.createDataFrame(rows, "version int, vslot int, shard int")


def save_map(spark: SparkSession, where: dict[int, int], path: str, version: int) -> None:
    """Adds a version to the stored map; earlier versions stay readable."""
    map_frame(spark, where, version).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[int, int], int]:
    """(map, version): the given version, or the latest."""
    stored = spark.read.schema("vslot int, shard int, version int").parquet(path)
    version = version if version is not None else stored.agg(F.max("version")).first()[0]
    return {r["vslot"]: r["shard"] for r in stored.where(F.col("version") == version).collect()}, version


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, own (a hash of the id, or of the text where that is null), rows.

    Repeated rows are one row with their number, added up in each task before the shuffle.
    """
    text, own = F.col("text").cast("string"), F.col("doc_id").cast("long")
    told = docs.select(
        own.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(own.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(own)).alias("own"),
    )
    return told.groupBy("doc_id", "size", "text_crc32", "own").agg(F.count("*").alias("rows"))


def runs(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, run, n, vslot: at most ``RUN`` repeated rows in each; the first run has the id's slot."""
    last = F.floor((F.col("rows") - 1) / RUN).cast("long")
    parts = counted(docs).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / RUNS_AT_ONCE).cast("long"))))
    begin = F.col("part") * RUNS_AT_ONCE
    told = parts.withColumn("run", F.explode(F.sequence(begin, F.least(last, begin + RUNS_AT_ONCE - 1))))
    slot = F.when(F.col("run") == 0, F.col("own")).otherwise(F.xxhash64("own", "run"))
    n = F.least(F.lit(RUN).cast("long"), F.col("rows") - F.col("run") * RUN)
    return told.select("doc_id", "size", "text_crc32", "run", n.alias("n"), F.pmod(slot, F.lit(slots)).cast("int").alias("vslot"))


def slot_bytes(told: DataFrame) -> DataFrame:
    """vslot, rows, bytes of the runs: at most a row for each slot."""
    return told.groupBy("vslot").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version for each document.

    The law is ``bytes``: shards hold nearly equal sums of sizes. ``slot`` numbers the rows
    of a shard from 0 without a gap, by virtual slot and then doc_id; the numbers come from
    the slots' row counts, so no shard is ever gathered in one task. The texts are read once:
    their sizes and prints are checkpointed. ``path`` is where the
    map is stored, by default a new folder in the checkpoint folder: the latest version there
    is edited for the present sizes and stored as the next one, if any slot moves.
    """
    spark = docs.sparkSession
    own = checkpointed(runs(docs, slots))
    told = slot_bytes(own).collect()
    if path is None:
        path = f"{checkpoint_folder(spark)}/slot-map-{uuid.uuid4().hex}"
        save_map(spark, dealt_in_turn(shards, slots), path, 1)
    old, version = load_map(spark, path)
    edited = rebalanced(old, {r["vslot"]: r["bytes"] for r in told}, shards)
    if edited != old:
        save_map(spark, edited, path, version + 1)
    where, version = load_map(spark, path)
    count = {r["vslot"]: r["rows"] for r in told}
    filled = [0] * shards
    placed = []
    for slot in sorted(where):
        placed.append((slot, where[slot], filled[where[slot]]))
        filled[where[slot]] += count.get(slot, 0)
    places = F.broadcast(spark.createDataFrame(placed, "vslot int, shard int, before long"))
    order = W.partitionBy("vslot").orderBy(
        F.col("doc_id").asc_nulls_first(),
        "text_crc32",
        "size",
        "run"
    ).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = own.withColumn("place", F.sum("n").over(order) - F.col("n")).join(places, "vslot")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    return placed.select("doc_id", "size", "text_crc32", "shard", "vslot", (F.col("before") + F.col("place")).alias("first"), each).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.lit(version).alias("map_version"),
    )
