"""Connected components of a distributed edge table, and cutting of lineage."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[[^]]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sampled(rows: DataFrame, size: int, of: int, salt: int) -> DataFrame:
    """At most ``size`` of ``rows``, the first by a hash of doc_id and text.

    ``of`` is how many of ``rows`` there are. A bound on the hash that leaves few more than
    ``size`` rows goes first, so that only these reach the sort.
    """
    bound = min(1.0, (size + 6 * math.sqrt(size) + 50) / max(of, 1))
    (h,) = spare(rows, "h")
    told = rows.withColumn(h, F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(1 << 32))).where(F.col(h) < int(bound * (1 << 32)))
    return told.orderBy(h, "doc_id", "text").limit(size).drop(h)


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (long) and text (string) of ``docs``, and ``more``.

    A column of the right type is taken as it is: an alias that the optimizer drops in some
    uses of the result and keeps in others would hide that their exchanges are the same.
    """
    types = dict(docs.dtypes)
    own = [F.col(c) if types[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))]
    return docs.select(*own, *more)


def dealt(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` dealt out by the keys; those whose ``name`` is marked as decided go anywhere."""
    decided = F.col(name).bitwiseAND(F.lit(1)) == 1
    return rows.repartition(
        shuffle_partitions(rows.sparkSession),
        F.when(decided, F.xxhash64(*[c for c, t in rows.dtypes if t != "binary"])).otherwise(F.xxhash64(*keys))
    )


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def are_stars(pairs: DataFrame) -> bool:
    """Whether each u of ``pairs`` (u, v) has one v, which is no u itself."""
    sides = [F.struct(F.col(c).alias("x"), F.lit(own).alias("own")) for c, own in (("u", 1), ("v", 0))]
    ends = pairs.select(F.inline(F.array(*sides)))
    told = ends.groupBy("x").agg(F.sum("own").alias("own"), F.count("*").alias("n"))
    return not told.agg(F.count_if((F.col("own") > 0) & (F.col("n") > 1))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that reaches a smaller one.

    Alternating large-star and small-star steps on the edges; the edge set halves its depth
    in each round, nothing is collected, and a round's edges are checkpointed. Rounds end when
    the edges are stars, which a further round would leave as they are. A node with many
    neighbours is only ever pre-aggregated by min and joined, never gathered.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = checkpointed(pairs)
    while not are_stars(pairs):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = checkpointed(small.where("u <> v").distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
