"""Discovery, packing, sync cycles, run logs, exports and merges on small cases with known answers."""

from __future__ import annotations

import datetime as dt
import os
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelake.operators import normalize, store, transfer, vector, watch
from tracelake.sources import discovery
from tracelake.streaming.sync import BoundedSync, RunLog


def test_packed_vectors(spark):
    rows = [(1, [1.0, -2.5, 1e-30]), (2, []), (3, None), (4, [0.1, None])]
    told = spark.createDataFrame(rows, "id int, v array<double>").repartition(1).select("id", vector.packed("v").alias("b"))
    held = {r["id"]: r["b"] for r in told.collect()}
    assert bytes(held[1]) == struct.pack("<3f", 1.0, -2.5, 1e-30) and bytes(held[2]) == b"" and held[3] is None and bytes(held[4]) == struct.pack("<2f", 0.1, 0.0)
    back = {r["id"]: r["v"] for r in told.select("id", vector.unpacked("b").alias("v")).collect()}
    assert back[1] == [1.0, -2.5, struct.unpack("<f", struct.pack("<f", 1e-30))[0]] and back[2] == [] and back[3] is None
    odd = spark.createDataFrame(
        [(1, bytearray(b"\0\0\x80?abc")), (2, bytearray(b"xy")), (3, bytearray(struct.pack("<f", 2.0)))],
        "id int, b binary"
    ).repartition(1)
    assert {r["id"]: r["v"] for r in odd.select("id", vector.unpacked("b").alias("v")).collect()} == {1: [1.0], 2: [], 3: [2.0]}


def test_nearest_reads_packed_vectors(spark):
    e = spark.createDataFrame(
        [(k, f"s{k % 3}", [float(k % 5), 1.0, float(k)]) for k in range(20)] + [(20, "s0", None), (21, "s1", [0.0, 0.0])],
        "message_id int, session_id string, embedding array<float>"
    )
    asked = spark.createDataFrame([(1, [1.0, 1.0, 3.0]), (2, [0.0, 1.0])], "query_id int, query_vector array<float>")
    plain, packed = vector.nearest(e, asked, 2), vector.nearest(e.withColumn("embedding", vector.packed("embedding")), asked, 2)
    assert sorted(plain.collect()) == sorted(packed.collect()) and plain.count() == 4


def test_embedding_run_stores_model_and_dimensions(spark):
    messages = spark.createDataFrame(
        [("1", "s", "a" * 4500), ("2", "s", "b"), ("3", "s", " ")],
        "id string, session_id string, content string"
    )
    held = spark.createDataFrame([("2",)], "message_id string")
    told = vector.embedding_run(
        messages,
        held,
        lambda texts: [[float(len(t)), 0.0] for t in texts],
        "tiny"
    ).orderBy("chunk_index").collect()
    assert [
        (r["message_id"], r["chunk_index"], r["dimensions"], r["embedding_model"], struct.unpack("<2f", r["embedding"])[0]) for r in told
    ] == [("1", k, 2, "tiny", n) for k, n in enumerate((2000.0, 2000.0, 500.0))]


def put(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_only_the_days_asked_for_are_opened(spark, tmp_path):
    day = dt.date(2023, 12, 30)
    for k in range(40):
        put(tmp_path / f"{day + dt.timedelta(days=k):%Y/%m/%d}" / "rollout-x.jsonl", f"{k}\n")
    put(tmp_path / "2024/01/02/deeper/rollout-y.jsonl", "no\n")
    put(tmp_path / "2024/01/02/notes.txt", "no\n")
    lines = discovery.dated_lines(spark, str(tmp_path), dt.date(2023, 12, 31), dt.date(2024, 2, 1))
    assert sorted(int(r["value"]) for r in lines.collect()) == list(range(1, 34))
    assert len(lines.inputFiles()) == 33
    assert sorted(
        r["day"] for r in discovery.dated(spark, str(tmp_path), dt.date(2024, 1, 1), dt.date(2024, 1, 3)).collect()
    ) == [dt.date(2024, 1, k) for k in (1, 2, 3)]
    assert discovery.dated(spark, str(tmp_path)).count() == 40
    none = dt.date(1999, 1, 1)
    assert discovery.dated(
        spark,
        str(tmp_path),
        none,
        none
    ).count() == 0 and discovery.dated_lines(spark, str(tmp_path), none, none).count() == 0
    assert discovery.day_globs(dt.date(2022, 12, 31), dt.date(2024, 2, 2)) == [
        "2022/12/31",
        "2023/*/*",
        "2024/01/*",
        "2024/02/01",
        "2024/02/02"
    ]


def test_subagents_are_found_one_level_below(spark, tmp_path):
    for name in ("-w-a/s1.jsonl", "-w-a/s1/agent.jsonl", "-w-a/s1/deep/no.jsonl", "-w-b/s2.jsonl", "top.jsonl", "-w-b/x.txt"):
        put(tmp_path / name, "{}\n")
    found = discovery.projects(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r["path"]), r["folder"], r["parent"]) for r in found) == [
        ("agent.jsonl", "-w-a", "s1"),
        ("s1.jsonl", "-w-a", None),
        ("s2.jsonl", "-w-b", None)
    ]


def test_a_newer_title_index_changes_its_source_alone(spark, tmp_path):
    put(tmp_path / "index.jsonl", "one\n")
    files = spark.createDataFrame(
        [("rollout", "a", 1, 2), ("rollout", "b", 1, 2), ("project", "c", 1, 2)],
        "source string, path string, mtime int, size int"
    )
    side = {"rollout": str(tmp_path / "index.jsonl"), "missing": str(tmp_path / "none.jsonl")}
    marks = discovery.signatures(spark, side)
    assert {r["source"]: r["signature"] is None for r in marks.collect()} == {"rollout": False, "missing": True}
    state = discovery.signed(files, marks).withColumn("status", F.lit("ok")).cache()
    assert {r["action"] for r in store.file_gate(discovery.signed(files, marks), state).collect()} == {"skip"}
    put(tmp_path / "index.jsonl", "one\ntwo\n")
    told = store.file_gate(discovery.signed(files, discovery.signatures(spark, side)), state).collect()
    assert {r["path"]: r["action"] for r in told} == {"a": "changed", "b": "changed", "c": "skip"}


def test_an_unchanged_cycle_is_not_pushed(spark, tmp_path):
    rows = spark.createDataFrame(
        [(str(k), f"t{k}", f"2024-01-{k % 28 + 1:02}") for k in range(40)],
        "id string, title string, started_at string"
    )
    pushed = []
    first = BoundedSync(spark, lambda: rows, lambda batch: pushed.append(batch.count()), str(tmp_path), newest=10)
    assert [first.cycle(0), first.cycle(1)] == [True, False]
    old = rows.withColumn("title", F.when(F.col("id") == "0", "beyond the newest").otherwise(F.col("title")))
    assert not BoundedSync(spark, lambda: old, first.push, str(tmp_path), newest=10).cycle(2)
    new = rows.withColumn("title", F.when(F.col("id") == "27", "changed").otherwise(F.col("title")))
    assert BoundedSync(spark, lambda: new, first.push, str(tmp_path), newest=10).cycle(3) and pushed == [10, 10]


def test_a_push_that_fails_is_tried_again(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2024")], "id string, started_at string")

    def fails(batch):
        raise OSError("no route")

    with pytest.raises(OSError):
        BoundedSync(spark, lambda: rows, fails, str(tmp_path)).cycle(0)
    assert BoundedSync(spark, lambda: rows, lambda batch: None, str(tmp_path)).cycle(1)


def test_streamed_cycles_are_logged(spark, tmp_path):
    changes = str(tmp_path / "changes")
    rows = spark.createDataFrame([("1", "2024")], "id string, started_at string")
    pushed, log = [], RunLog()
    spark.streams.addListener(log)
    sync = BoundedSync(spark, lambda: rows, lambda batch: pushed.append(1), str(tmp_path / "state"))
    for k in range(2):
        spark.range(k, k + 1).write.mode("append").parquet(changes)
        sync.stream(spark.readStream.schema("id long").parquet(changes), name="box").awaitTermination()
    for _ in range(100):
        if len(log.rows) >= 2:
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(log)
    assert pushed == [1]
    told = watch.last_runs(log.table(spark)).collect()
    assert [(r["source"], r["last_error"]) for r in told] == [("box", None)] and told[0]["last_success_at"] >= told[0]["last_attempt_at"]


def test_status_of_sources(spark):
    at = lambda k: dt.datetime(2024, 1, 1, 0, 0, k)
    runs = spark.createDataFrame(
        [("a", at(1), at(2), 3, 0, None), ("a", at(5), None, None, None, "boom"), ("b", at(3), at(4), 1, 2, None)],
        watch.RUNS
    )
    files = spark.createDataFrame(
        [("a", "x", at(10), 1), ("a", "y", at(20), 1), ("c", "z", at(9), 1)],
        "source string, path string, mtime timestamp, size int"
    )
    state = files.where("path <> 'x'").withColumn("status", F.lit("ok"))
    told = {r["source"]: r.asDict() for r in watch.status(files, state, runs, F.lit(at(30))).collect()}
    assert told["a"] == {
        "source": "a", "ok": 1, "pending": 1, "lag_seconds": 20, "last_attempt_at": at(5), "last_success_at": at(2), "skipped_files": 3, "last_error": "boom"
    }
    assert (told["b"]["lag_seconds"], told["b"]["last_success_at"], told["b"]["last_error"]) == (None, None, "2 files failed to ingest")
    assert (told["c"]["lag_seconds"], told["c"]["last_attempt_at"], told["c"]["skipped_files"]) == (0, None, 0)


def test_export_and_import_give_the_same_back(spark, tmp_path):
    lines = ['{"cwd":"/a/b","m":{"cwd":"/a/b/c"},"t":"\\"cwd\\":\\"/a/b\\""}', '{"cwd" : "/a/bc"}', "[1]", "", '{"cwd":"/a/b']
    rows = [("-a-b", "s 1%.jsonl", k, v) for k, v in enumerate(lines)] + [("-a-bc", "s2.jsonl", 0, '{"x":1}'), ("-z", "s3.jsonl", 0, "{}")]
    records = spark.createDataFrame(rows, "project string, file string, ord int, value string")
    folder = str(tmp_path / "out")
    told = {
        r["project"]: (r["files"], r["bytes"]) for r in transfer.export(
            records,
            folder,
            records.where("project <> '-z'").select("project")
        ).collect()
    }
    size = sum(len(v) + 1 for v in lines)
    assert told == {"-a-b": (1, size), "-a-bc": (1, 8), None: (2, size + 8)}
    good, bad, report = transfer.imported(spark, folder, spark.createDataFrame([], "project string, file string"), "/a/b", "/n$")
    moved = ['{"cwd":"/n$","m":{"cwd":"/n$/c"},"t":"\\"cwd\\":\\"/a/b\\""}', '{"cwd" : "/a/bc"}']
    assert sorted(tuple(r) for r in good.collect()) == [("-a-bc", "s2.jsonl", 0, '{"x":1}')] + [
        ("-n$", "s 1%.jsonl", k, v) for k, v in enumerate(moved)
    ]
    assert sorted(r["ord"] for r in bad.collect()) == [2, 3, 4]
    assert {
        (r["project"], r["action"], r["lines"], r["bad_lines"]) for r in report.collect()
    } == {("-n$", "remapped", 5, 3), ("-a-bc", "imported", 1, 0)}
    again, _, report = transfer.imported(spark, folder, good.select("project", "file"), "/a/b", "/n$")
    assert again.count() == 0 and {r["action"] for r in report.collect()} == {"skipped"}
    assert transfer.imported(spark, folder, good.select("project", "file"), "/a/b", "/n$", overwrite=True)[0].count() == good.count()


def test_a_refused_payload_changes_nothing(spark):
    held = {"transcripts": [("1", "old"), ("2", "old")], "messages": [("a", "1"), ("b", "2")], "tool_calls": [("x", "1")]}
    new = {"transcripts": [("1", "new"), ("2", "new"), ("3", "new")], "messages": [("c", "1"), ("d", "2"), ("e", "3")], "tool_calls": []}
    shapes = {
        "transcripts": "id string, title string", "messages": "id string, session_id string", "tool_calls": "id string, session_id string"
    }
    frames = lambda told: {k: spark.createDataFrame(v, shapes[k]) for k, v in told.items()}
    errors = spark.createDataFrame([("1", None), ("2", None), ("2", "invalid_role"), ("3", None)], "id string, error string")
    out, report = transfer.content_imported(frames(held), frames(new), errors)
    assert sorted(tuple(r) for r in out["transcripts"].collect()) == [("1", "new"), ("2", "old"), ("3", "new")]
    assert sorted(r["id"] for r in out["messages"].collect()) == ["b", "c", "e"] and out["tool_calls"].count() == 0
    assert {r["id"]: (r["accepted"], r["fault"]) for r in report.collect()} == {
        "1": (True, None), "2": (False, "invalid_role"), "3": (True, None)
    }


def test_counts_of_touched_transcripts(spark):
    transcripts = spark.createDataFrame(
        [("1", 9, 9, 9), ("2", 9, 9, 9), ("3", 9, 9, 9)],
        "id string, message_count long, tool_call_count long, total_input_tokens long"
    )
    messages = spark.createDataFrame([("1", 5), ("1", None), ("3", 7)], "session_id string, input_tokens long")
    calls = spark.createDataFrame([("3",)], "session_id string")
    touched = spark.createDataFrame([("1", None), ("2", None), ("4", 3)], "id string, total_input_tokens long")
    told = {r["id"]: tuple(r)[1:] for r in store.recounted(transcripts, messages, calls, touched).collect()}
    assert told == {"1": (2, 0, 5), "2": (0, 0, 0), "3": (9, 9, 9)}
    explicit = spark.createDataFrame([("1", 0)], "id string, total_input_tokens long")
    assert store.recounted(transcripts, messages, calls, explicit).where("id = '1'").first()["total_input_tokens"] == 0


def test_merge_reports_what_came_in(spark):
    shape = "id string, source string, source_id string, machine string"
    target = {
        "transcripts": spark.createDataFrame([("1", "a", "x", "m1")], shape), "messages": spark.createDataFrame(
            [("q", "1", "u")],
            "id string, session_id string, source_id string"
        )
    }
    source = {
        "transcripts": spark.createDataFrame([("9", "a", "x", "m2"), ("2", "a", "y", "m2")], shape), "messages": spark.createDataFrame(
            [("r", "9", "u"), ("s", "9", None), ("t", "2", "u"), ("q", "2", "w")],
            "id string, session_id string, source_id string"
        )
    }
    machines = spark.createDataFrame([("m1", 5)], "name string, session_count long")
    merged, added = store.stores_merged(target | {"machines": machines}, source)
    assert {r["tab"]: r["added"] for r in store.merge_report(added).collect()} == {"transcripts": 1, "messages": 2}
    assert sorted((r["id"], r["session_id"]) for r in merged["messages"].collect()) == [("q", "1"), ("s", "1"), ("t", "2")]
    assert {r["name"]: r["session_count"] for r in merged["machines"].collect()} == {"m1": 1, "m2": 1}


def test_digests_do_not_depend_on_the_order_of_keys(spark):
    texts = [
        '{"b":[{"y":1,"x":{"q":2,"p":null}}],"a":"é\\n"}',
        '{ "a" : "é\\n", "b" : [ {"x":{"p":null,"q":2},"y":1} ] }',
        '{"b":[{"y":1,"x":{"q":2,"p":0}}],"a":"é\\n"}',
        "no json"
    ]
    told = [
        r["d"] for r in spark.createDataFrame(
            [(k, t) for k, t in enumerate(texts)],
            "k int, t string"
        ).select("k", normalize.record_digest("t").alias("d")).orderBy("k").collect()
    ]
    assert told[0] == told[1] != told[2] and len(set(told)) == 3 and None not in told


def test_imports_of_projects_that_hold_a_text(spark, tmp_path):
    records = spark.createDataFrame(
        [("-w-Alpha", "a", 0, "{}"), ("-w-beta", "b", 0, "{}")],
        "project string, file string, ord int, value string"
    )
    transfer.export(records, str(tmp_path / "out"))
    good, _, report = transfer.imported(
        spark,
        str(tmp_path / "out"),
        spark.createDataFrame([], "project string, file string"),
        holding="alph"
    )
    assert [r["project"] for r in good.collect()] == ["-w-Alpha"] and report.count() == 1


def test_compact_metadata(spark):
    told = normalize.compact_metadata(
        {"a": F.lit(""), "b": F.lit("NaN")},
        {"c": F.lit(float("nan")), "d": F.lit(float("inf")), "e": F.lit(2), "f": F.lit(None).cast("double")}
    )
    assert spark.range(1).select(told.alias("m")).first()["m"] == '{"b":"NaN","e":2}'
    assert spark.range(1).select(normalize.compact_metadata({"a": F.lit(None).cast("string")}).alias("m")).first()["m"] == "{}"
