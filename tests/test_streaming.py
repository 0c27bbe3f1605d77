"""Streams give the same table as a batch, and a restart adds nothing."""

from __future__ import annotations

from tracelake.operators.store import preferred
from tracelake.streaming.ingest import SnapshotTable, stream_snapshots, unchanged

SCHEMA = "key string, messages int, tool_calls int, mtime int, path string"


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    rows = [(f"k{i % 7}", i % 5, i % 3, i, f"p{i}") for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        frame.where(f"mtime % 3 = {2 - k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"drop{k}"))
    source = str(tmp_path / "in" / "*")
    table = SnapshotTable(spark, str(tmp_path / "table"), ["key"])
    for _ in range(2):
        stream_snapshots(spark, source, frame.schema, table, str(tmp_path / "state"), files_per_batch=1).awaitTermination()
    want = preferred(frame, ["key"])
    assert sorted(table.read().collect()) == sorted(want.collect())
    assert unchanged(table.read(), want, want.columns)
