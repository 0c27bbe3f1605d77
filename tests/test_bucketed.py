"""A bucketed table: changes rewrite touched buckets only, layers add up, failed writes are never read."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tracelake.bucketed import BucketedTable
from tracelake.operators.store import preferred
from tracelake.streaming.ingest import SnapshotTable

ROWS = "k string, v long"


def filled(spark, folder, rows, buckets=16):
    table = BucketedTable(spark, str(folder), ["k"], buckets)
    table.replace(spark.createDataFrame(rows, ROWS))
    return table


def held(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def test_change_rewrites_only_touched_buckets(spark, tmp_path):
    table = filled(spark, tmp_path, [*[(f"k{i}", i) for i in range(200)], (None, -1)])
    new = spark.createDataFrame([("k7", 70), ("new", 1), (None, -2)], ROWS)
    touched = table.touched(new)
    table.change(new, lambda rows: rows.join(new.select("k"), rows.k.eqNullSafe(new.k), "left_anti").unionByName(new))
    want = sorted([*[(f"k{i}", i) for i in range(200) if i != 7], ("k7", 70), ("new", 1), (None, -2)], key=str)
    assert held(table) == want
    written = {n for n in os.listdir(tmp_path / "changes" / "1") if "=" in n}
    assert written == {f"_bucket={b}" for b in touched} and len(written) <= 3
    assert len(held(table, 0)) == 201 and ("k7", 7) in held(table, 0)


def test_layers_empty_tables_and_lost_buckets(spark, tmp_path):
    table = filled(spark, tmp_path / "a", [])
    assert table.read().schema.simpleString() == "struct<k:string,v:bigint>" and held(table) == []
    table.append(spark.createDataFrame([("a", 1)], "k string, v int"))
    table.append(spark.createDataFrame([("a", 2)], ROWS))
    assert held(table) == [("a", 1), ("a", 2)] and set(table.layers().values()) == {2}
    (deep,) = table.layers()
    table.change({deep}, lambda rows: rows.where("v = 2"))
    assert held(table) == [("a", 2)] and table.layers() == {deep: 1}
    table.change({deep}, lambda rows: rows.where("false"))
    assert held(table) == [] and table.layers() == {}
    before = table.versions()
    table.change(table.read().where("false"), lambda rows: rows)
    assert table.versions() == before
    assert BucketedTable(spark, str(tmp_path / "none"), ["k"]).read() is None
    with pytest.raises(KeyError):
        BucketedTable(spark, str(tmp_path / "none"), ["k"]).append(table.read())


def test_rows_outside_and_failed_writes_change_nothing(spark, tmp_path):
    table = filled(spark, tmp_path, [(f"k{i}", i) for i in range(50)])
    one = spark.createDataFrame([("k1",)], "k string")
    with pytest.raises(ValueError, match="outside"):
        table.change(one, lambda rows: spark.createDataFrame([(f"x{i}", i) for i in range(50)], ROWS))
    with pytest.raises(Exception, match="broken"):
        table.change(one, lambda rows: rows.withColumn("v", F.raise_error(F.lit("broken")).cast("long")))
    assert table.versions() == [0] and len(held(table)) == 50
    table.change(one, lambda rows: rows.withColumn("v", F.when(F.col("k") == "k1", 100).otherwise(F.col("v"))))
    assert held(table) == sorted([*[(f"k{i}", i) for i in range(50) if i != 1], ("k1", 100)], key=str)
    again = BucketedTable(spark, str(tmp_path), ["k"], buckets=3)
    assert again.touched(one) == table.touched(one)


def test_snapshots_in_layers_equal_a_batch(spark, tmp_path):
    schema = "key string, messages int, tool_calls int, mtime int, path string"
    rows = [(f"k{(i * i) % 11}", i % 5, i % 3, i, f"p{i}") for i in range(60)]
    table = SnapshotTable(spark, str(tmp_path), ["key"], buckets=4, most=2)
    for k in (3, 0, 2, 1, 0):
        table.merge(spark.createDataFrame(rows[k::4], schema))
        assert max(table.held.layers().values()) <= 2
    want = preferred(spark.createDataFrame(rows, schema), ["key"])
    assert sorted(table.read().collect()) == sorted(want.collect())


def test_vacuum_keeps_what_the_last_versions_name(spark, tmp_path):
    table = filled(spark, tmp_path, [(f"k{i}", i) for i in range(50)])
    for v in (100, 200, 300):
        table.change(
            spark.createDataFrame([("k1",)], "k string"), lambda rows, v=v: rows.withColumn(
                "v",
                F.when(F.col("k") == "k1", v).otherwise(F.col("v"))
            )
        )
    before = held(table)
    assert table.vacuum(keep=1) == [0, 1, 2] and table.versions() == [3]
    assert held(table) == before and sorted(os.listdir(tmp_path / "changes")) == ["0", "3"]
    assert len([n for n in os.listdir(tmp_path / "changes" / "0") if "=" in n]) == len(table.layers()) - 1


def test_a_version_written_meanwhile_is_an_error(spark, tmp_path):
    table = filled(spark, tmp_path, [("a", 1)])
    new = spark.createDataFrame([("a", 2)], ROWS)

    def meanwhile(rows):
        BucketedTable(spark, str(tmp_path), ["k"])._commit(1, rows.schema, 16, {})
        return new

    with pytest.raises(RuntimeError, match="meanwhile"):
        table.change(new, meanwhile)
    assert table.versions() == [0, 1]
