"""The store facade end to end: files in, questions answered, vectors stored, payloads judged, stores merged."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tracelake.store import TranscriptStore


def transcript(folder, name, *turns):
    """A file of a provider's folder; a turn is (role, content)."""
    lines = [
        json.dumps(
            {
                "type": role, "uuid": f"u{k}", "cwd": f"/w/{name}", "timestamp": f"2024-01-0{k + 1}", "message": {
                    "role": role, "content": content, "model": "m", "usage": {"input_tokens": k + 1}
                }
            }
        ) for k, (role, content) in enumerate(turns)
    ]
    (folder / f"-w-{name}").mkdir(parents=True, exist_ok=True)
    (folder / f"-w-{name}" / f"{name}.jsonl").write_text("\n".join(lines))


def counted(texts):
    return [[float(t.lower().count("café")), float(t.lower().count("parser")), 0.1] for t in texts]


def test_files_to_answers(spark, tmp_path):
    files = tmp_path / "files"
    transcript(
        files,
        "one",
        ("user", "Fix the Café parser"),
        (
            "assistant",
            [{"type": "text", "text": "done"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "make café"}}]
        )
    )
    transcript(
        files,
        "two",
        ("user", "unrelated words"),
        ("assistant", [{"type": "tool_result", "content": [{"type": "text", "text": "nothing of it"}]}])
    )
    store = TranscriptStore(spark, str(tmp_path / "store"), buckets=4)
    store.ingest("project", str(files))
    rows = {r["project_name"]: r for r in store.table("transcripts").collect()}
    assert {
        k: (r["message_count"], r["tool_call_count"], r["total_input_tokens"]) for k, r in rows.items()
    } == {"one": (2, 1, 3), "two": (2, 0, 3)}
    store.ingest("project", str(files))
    assert store.table("transcripts").count() == 2 and store.table("messages").count() == 4
    asked = spark.createDataFrame([(1, "cafe")], "query_id int, query string")
    hit = store.search_content(asked).collect()
    assert [(h["project_name"], h["snippet"]) for h in hit] == [("one", "Fix the [Café] parser")]
    assert [h["snippet"] for h in store.search_tools(asked).collect()] == ['{"command":"make [café]"}']
    assert store.commands().first()["command"] == "make café"
    assert store.embed(counted, "tiny") == 4 and store.embed(counted, "tiny") == 0
    vectors = spark.createDataFrame([(1, [1.0, 1.0, 0.1])], "query_id int, query_vector array<double>")
    near = store.semantic_search(vectors).orderBy("pos").first()
    assert near["snippet"] == "Fix the Café parser" and near["pos"] == 1
    told = store.recall(asked, vectors).orderBy("rank").collect()
    assert (told[0]["title"], told[0]["semantic_status"], told[0]["rank"]) == ("Fix the Café parser", "used", 1)
    assert "semantic" in told[0]["signals"] and told[0]["evidence"][0]["snippet"] == "Fix the [Café] parser"
    assert store.recall(asked).first()["semantic_status"] == "off"
    assert store.hybrid_search(asked, vectors).orderBy("pos").first()["session_id"] == rows["one"]["id"]
    assert {r["bytes"] > 100 for r in store.sizes().collect()} == {True} and store.sizes().count() == 2


def test_payloads_and_merge(spark, tmp_path):
    heads = "id string, source string, source_id string, title string, machine string, message_count long, tool_call_count long, started_at string"
    said, used = "id string, session_id string, source_id string, role string, sequence_num int", "id string, session_id string, tool_name string, status string"

    def filled(folder, ids, machine):
        store = TranscriptStore(spark, str(tmp_path / folder), buckets=4)
        store.save("transcripts", spark.createDataFrame([(i, "project", f"n{i}", "t", machine, 1, 0, "2024") for i in ids], heads))
        store.save("messages", spark.createDataFrame([(f"m{i}", i, "u", "user", 0) for i in ids], said))
        store.save("tool_calls", spark.createDataFrame([], used))
        return store

    one = filled("one", ["a", "b"], "box")
    payload = {
        "transcripts": spark.createDataFrame([(i, "project", f"n{i}", "new", "box", 1, 0, "2024") for i in "abc"], heads),
        "messages": spark.createDataFrame([("x", "a", "u", "user", 0), ("y", "b", "u", "robot", 0)], said),
        "tool_calls": spark.createDataFrame([("z", "c", "Bash", "success")], used),
    }
    report = {r["id"]: (r["accepted"], r["fault"]) for r in one.import_content(payload, ["project"], ["success"]).collect()}
    assert report == {"a": (True, None), "b": (False, "invalid_role"), "c": (True, None)}
    assert {r["id"]: r["title"] for r in one.table("transcripts").collect()} == {"a": "new", "b": "t", "c": "new"}
    assert sorted(r["id"] for r in one.messages(spark.createDataFrame([("a",), ("b",)], "id string")).collect()) == ["mb", "x"]
    one.recompute_machines()
    assert [tuple(r) for r in one.machines().collect()] == [("box", 3)]
    filled("two", ["b", "d"], "other")
    assert {r["tab"]: r["added"] for r in one.merge(str(tmp_path / "two")).collect()} == {"transcripts": 1, "messages": 1, "tool_calls": 0}
    assert [tuple(r) for r in one.machines().collect()] == [("box", 3), ("other", 1)]
    assert one.listed(F.col("machine") == "other").first()["id"] == "d"


def test_changes_touch_only_their_buckets(spark, tmp_path):
    store = TranscriptStore(spark, str(tmp_path), buckets=16)
    heads = "id string, source string, source_id string, title string, project_path string, source_path string, message_count long, tool_call_count long"
    store.save("transcripts", spark.createDataFrame([(f"t{i}", "project", f"n{i}", "old", "/w", f"/f{i}", 0, 0) for i in range(60)], heads))
    store.save(
        "messages",
        spark.createDataFrame([(f"m{i}", f"t{i % 60}", i) for i in range(180)], "id string, session_id string, sequence_num int")
    )
    store.save("tool_calls", spark.createDataFrame([], "id string, session_id string, tool_name string"))
    store.rename(spark.createDataFrame([("t3", "fresh"), ("none", "x")], "id string, title string"))
    written = lambda name, n: [p.name for p in (tmp_path / name / "changes" / str(n)).iterdir() if "=" in p.name]
    assert len(written("transcripts", 1)) == 1 and {
        r["title"] for r in store.table("transcripts").where("id = 't3'").collect()
    } == {"fresh"}
    store.put(
        spark.createDataFrame([("other", "project", "n5", "put", "/w", "/f5", 0, 0)], heads),
        spark.createDataFrame([("x", "other", 0)], "id string, session_id string, sequence_num int"),
        spark.createDataFrame([], "id string, session_id string, tool_name string"),
    )
    row = store.table("transcripts").where("source_id = 'n5'").collect()
    assert [(r["id"], r["title"], r["message_count"]) for r in row] == [("t5", "put", 1)]
    assert len(written("messages", 1)) == 1 and store.table("messages").count() == 178
    store.delete_transcripts(spark.createDataFrame([("t5",), ("t6",)], "session_id string"))
    assert store.table("transcripts").count() == 58 and store.table("messages").count() == 174
    assert store.table("transcripts", 0).count() == 60
    store.vacuum(keep=1)
    assert store.table("transcripts").count() == 58 and store.table("messages").count() == 174
