"""Queries: sources, normalization, panes, streaming. Records are rebuilt from conversations as JSON and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators import panes as P
from ..operators import store as O
from ..operators.materialize import checkpoint_folder
from ..sources import jsonl
from ..streaming.ingest import SnapshotTable, stream_snapshots
from . import views as V
from .registry import register
from .views import with_views


def _records(spark, sf_dir):
    """One provider-A file a conversation: message records with usage and, on even turns of the assistant, a tool use."""
    c = V.table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    blocks = F.concat(
        F.lit('[{"type":"text","text":'),
        F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9),
        F.lit('},{"type":"tool_use","id":"t'),
        turn,
        F.lit('","name":"Tool'),
        (F.col("turn") % 3).cast("string"),
        F.lit('","input":{"n":'),
        turn,
        F.lit("}}]")
    )
    plain = F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9)
    content = F.when(F.col("role") == "assistant", blocks).otherwise(plain)
    value = F.concat(
        F.lit('{"type":"'), F.when(F.col("role") == "assistant", "assistant").otherwise("user"), F.lit('","uuid":"u'), (F.col("turn") % 4).cast("string"), F.lit('","cwd":"/w/p'), (F.col("conv_id") % 7).cast("string"),
        F.lit('","timestamp":"2024-01-'), F.lpad((28 - F.col("turn") % 20).cast("string"), 2, "0"), F.lit('","message":{"role":"'), F.col("role"), F.lit('","model":"m'), (F.col("turn") % 2).cast("string"),
        F.lit('","usage":{"input_tokens":'), (F.col("turn") + 1).cast("string"), F.lit(',"output_tokens":'), (F.col("turn") * 2).cast("string"), F.lit('},"content":'), content, F.lit("}}"),
    )
    return c.select(F.concat(F.lit("s"), conv).alias("file"), F.col("turn").alias("ord"), value.alias("value"))


def _json(text):
    """A text as a JSON string."""
    packed = F.to_json(F.struct(text.alias("t")))
    return packed.substr(F.lit(6), F.length(packed) - 6)


def _odd_records(spark, sf_dir):
    """Records whose contents take turns: text, text that looks like JSON, nested results, strings among blocks, values of wrong kinds, no content."""
    c = V.table(spark, sf_dir, "conversations").withColumn("said", _json(F.col("text")))
    k = F.col("turn") % 6
    part = lambda text: F.expr(f"""replace('{text}', '$', said)""")
    content = (
        F.when(k == 0, F.col("said"))
        .when(k == 1, _json(F.concat(F.lit('["'), "conv_id", F.lit('"]'))))
        .when(k == 2, part('[" first", {"type":"text","text":$}, "", "last "]'))
        .when(k == 3, part('[{"type":"tool_result","content":[{"type":"text","text":$},{"type":"tool_result","content":["deep",{"thinking":"t"}]}]},{"type":"image","source":{}}]'))
        .when(k == 4, part('[{"type":"tool_result","content":$},{"type":"tool_result","content":{"a":1}},{"text":5},{"type":"tool_result","content":null},7]'))
        .otherwise(part('{"type":"text","text":$}'))
    )
    value = F.concat(
        F.lit('{"type":"user","message":{"role":"'),
        "role",
        F.lit('","usage":{"input_tokens":'),
        (F.col("turn") + 1).cast("string"),
        F.lit('},"content":'),
        content,
        F.lit("}}")
    )
    return c.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("ord"), value.alias("value"))


_ODD = """SELECT conv_id, turn, role, CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN '["' || conv_id || '"]' WHEN 2 THEN
    'first' || chr(10) || text || chr(10) || chr(10) || 'last'
    WHEN 3 THEN trim(text || chr(10) || 'deep' || chr(10) || 't', white) WHEN 4 THEN trim(text,
    white) ELSE '' END AS content FROM conversations,
    (SELECT chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' AS white)"""


@register(
    "records_roundtrip_parse",
    f"""SELECT 's' || conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence_num, role,
        content, turn + 1 AS input_tokens FROM ({_ODD})"""
)
def records_roundtrip_parse(spark, sf_dir):
    return N.project_messages(_odd_records(spark, sf_dir)).select("file", "sequence_num", "role", "content", "input_tokens")


@register("ingest_fold_transcripts", """SELECT 's' || conv_id AS file, '/w/p' || conv_id % 7 AS project_path,
    'p' || conv_id % 7 AS project_name, arg_max('m' || turn % 2, turn) AS model,
    arg_min('2024-01-' || lpad(CAST(28 - turn % 20 AS VARCHAR), 2, '0'), turn) AS started_at,
    arg_max('2024-01-' || lpad(CAST(28 - turn % 20 AS VARCHAR), 2, '0'), turn) AS ended_at,
    count(*) AS message_count, CAST(sum(turn + 1) AS BIGINT) AS total_input_tokens,
    CAST(sum(turn * 2) AS BIGINT) AS total_output_tokens, substr(trim(regexp_replace(arg_min(text,
    turn) FILTER (role = 'user' AND trim(text) <> ''), '\\s+', ' ', 'g')), 1, 120) AS title FROM conversations
    GROUP BY conv_id""")
def ingest_fold_transcripts(spark, sf_dir):
    records = _records(spark, sf_dir)
    told = N.project_transcripts(records, N.project_messages(records))
    return told.select(
        "file",
        "project_path",
        "project_name",
        "model",
        "started_at",
        "ended_at",
        "message_count",
        "total_input_tokens",
        "total_output_tokens",
        "title"
    )


@register(
    "duplicate_uuid_suffix",
    """SELECT 's' || conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence_num,
        'u' || turn % 4 || CASE WHEN row_number() OVER (PARTITION BY conv_id,
        turn % 4 ORDER BY turn) > 1 THEN ':' || (row_number() OVER (PARTITION BY conv_id,
        turn % 4 ORDER BY turn) - 1) ELSE '' END AS source_id FROM conversations"""
)
def duplicate_uuid_suffix(spark, sf_dir):
    return N.project_messages(_records(spark, sf_dir)).select("file", "sequence_num", "source_id")


@register(
    "tool_use_blocks",
    """SELECT 's' || conv_id AS file, 'Tool' || turn % 3 AS tool_name, '{\"n\":' || turn || '}' AS tool_input
        FROM conversations WHERE role = 'assistant'"""
)
def tool_use_blocks(spark, sf_dir):
    return N.tool_uses(N.project_messages(_records(spark, sf_dir))).select("file", "tool_name", "tool_input")


@register(
    "canonical_events",
    """SELECT 's' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS seq, type,
        content FROM (SELECT conv_id, turn, 0 AS k, role AS type,
        CASE WHEN role = 'assistant' THEN text ELSE text END AS content FROM conversations
        UNION ALL SELECT conv_id, turn, 1, 'tool_call', '{\"n\":' || turn || '}' FROM conversations
        WHERE role = 'assistant')"""
)
def canonical_events(spark, sf_dir):
    told = N.project_messages(_records(spark, sf_dir)).withColumnRenamed("file", "session_id")
    return N.canonical_events(told).select("session_id", "seq", "type", "content")


_EVENTS = """ev AS (SELECT conv_id, 's' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn,
    k) AS n, type, content FROM (SELECT conv_id, turn, 0 AS k, role AS type, text AS content FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'tool_call:Tool' || turn % 3, '{\"n\":' || turn || '}' FROM conversations
    WHERE role = 'assistant'))"""
_OWN = """'"sessionId":"s' || conv_id || '","cwd":"/tmp"'"""


@register("native_jsonl_lines", """WITH {_EVENTS} SELECT session_id, CAST(n AS INTEGER) AS n,
    CASE WHEN type = 'user' THEN '{"type":"user",' || {_OWN} || ',"message":{"role":"user","content":' ||
    to_json(content) || '}}' ELSE '{"type":"assistant",' || {_OWN} || ',"message":{"role":"assistant","content":[' ||
    CASE WHEN starts_with(type, 'tool_call') THEN '{"type":"tool_use","id":"tool_' || (n - 1) || '","name":"' ||
    substr(type, 11) || '","input":' || content || '}' WHEN type = 'system' THEN '{"type":"text","text":' ||
    to_json('[System context]' || chr(10) || content) || '}' ELSE '{"type":"text","text":' || to_json(content) || '}'
    END || '],"model":"unknown-model"}}' END AS line FROM ev
    UNION ALL SELECT DISTINCT session_id, 0, '{"type":"header",' || {_OWN} || ',"version":"1.0.0"}' FROM ev
    UNION ALL SELECT session_id, CAST(max(n) + 1 AS INTEGER),
    '{"type":"custom-title","customTitle":"Title ' || conv_id || '",' || {_OWN} || '}' FROM ev WHERE conv_id % 3 = 0
    GROUP BY session_id, conv_id""".replace("{_EVENTS}", _EVENTS).replace("{_OWN}", _OWN))
def native_jsonl_lines(spark, sf_dir):
    events = N.canonical_events(N.project_messages(_records(spark, sf_dir)).withColumnRenamed("file", "session_id"))
    titles = V.table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(F.lit("Title "), F.col("conv_id").cast("string")).alias("title")
    ).distinct()
    return N.native_lines(events, titles=titles)


@register(
    "external_summary",
    f"""WITH {_EVENTS} SELECT session_id, count(*) AS events, count(*) FILTER (type = 'user') AS user_events,
        count(*) FILTER (starts_with(type, 'tool_call')) AS tool_calls, regexp_replace(arg_max(type, n), ':.*',
        '') AS last_type FROM ev GROUP BY session_id"""
)
def external_summary(spark, sf_dir):
    return N.events_summary(N.canonical_events(N.project_messages(_records(spark, sf_dir)).withColumnRenamed("file", "session_id")))


_ROLLOUT = "0a1b2c3d-0000-4000-8000-"


@register(
    "rollout_events",
    """SELECT '{_ROLLOUT}' || lpad(CAST(conv_id AS VARCHAR), 12, '0') AS session_id,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
        CASE turn % 5 WHEN 4 THEN 'thinking' WHEN 3 THEN 'tool_result' WHEN 2 THEN 'tool_call' ELSE role END AS type,
        CASE turn % 5 WHEN 2 THEN '{\"t\":' || turn || '}' ELSE text END AS content,
        CASE WHEN turn % 5 = 2 THEN 'run' END AS tool_name FROM conversations
        WHERE trim(text) <> '' OR turn % 5 IN (2, 3)""".replace("{_ROLLOUT}", _ROLLOUT)
)
def rollout_events(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    k, none = F.col("turn") % 5, F.lit(None).cast("string")
    kind = F.when(k == 4, "reasoning").when(k == 3, "function_call_output").when(k == 2, "function_call").otherwise("message")
    role = F.when(k < 2, F.when(F.col("role") == "system", "developer").otherwise(F.col("role")))
    content = F.when(k.isin(0, 1, 4), F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"))))
    arguments = F.when(k == 2, F.concat(F.lit('{"t":'), F.col("turn").cast("string"), F.lit("}")))
    payload = F.struct(
        kind.alias("type"),
        role.alias("role"),
        content.alias("content"),
        F.when(k == 2, F.lit("run")).otherwise(none).alias("name"),
        arguments.alias("arguments"),
        F.when(k == 3, F.col("text")).alias("output")
    )
    file = F.concat(
        F.lit("/x/2024/05/06/rollout-2024-05-06T07-08-09-" + _ROLLOUT),
        F.lpad(F.col("conv_id").cast("string"), 12, "0"),
        F.lit(".jsonl")
    )
    return N.rollout_events(
        c.select(
            file.alias("file"),
            F.col("turn").alias("ord"),
            F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))).alias("value")
        )
    )


@register(
    "rollout_records_parse",
    """SELECT 'r' || conv_id AS file, CASE WHEN turn % 5 = 4 THEN 'thinking' WHEN role = 'system' THEN 'system' ELSE
        role END AS role, CASE WHEN turn % 5 = 4 THEN 'short: ' || turn ELSE trim(text,
        chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') END AS content,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence_num FROM conversations
        WHERE turn % 5 = 4 OR trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' AND turn % 7
        <> 6"""
)
def rollout_records_parse(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    kind = F.when(F.col("turn") % 5 == 4, "reasoning").otherwise("message")
    text = F.when(F.col("turn") % 7 == 6, " ").otherwise(F.col("text"))
    summary = F.when(
        F.col("turn") % 5 == 4,
        F.array(F.struct(F.lit("summary_text").alias("type"), F.concat(F.lit("short: "), "turn").alias("text")))
    )
    value = F.to_json(
        F.struct(
            F.lit("response_item").alias("type"),
            F.struct(
                kind.alias("type"),
                role.alias("role"),
                F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"))).alias("content"),
                summary.alias("summary")
            ).alias("payload")
        )
    )
    return N.rollout_messages(
        c.select(F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("ord"), value.alias("value"))
    ).select("file", "role", "content", "sequence_num")


@register("tool_call_pairing", """SELECT user_id, call_ord, arguments, output
    FROM (SELECT c.user_id, c.event_id AS call_ord, c.props AS arguments, (SELECT arg_max(o.props, o.event_id)
    FROM events o WHERE o.user_id = c.user_id AND o.event_type = 'purchase' AND o.event_id > c.event_id AND o.event_id <
    coalesce(c.next, 9223372036854775807)) AS output
    FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events
    WHERE event_type = 'view') c)""")
def tool_call_pairing(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    kind = F.when(F.col("event_type") == "view", "function_call").otherwise("function_call_output")
    told = e.select(
        F.col("user_id").alias("file"),
        F.col("event_id").alias("ord"),
        kind.alias("kind"),
        F.lit("c").alias("call_id"),
        F.col("event_type").alias("name"),
        F.col("props").alias("arguments"),
        F.col("props").alias("output")
    )
    return N.paired(told).select(F.col("file").alias("user_id"), F.col("ord").alias("call_ord"), "arguments", "output")


@register(
    "subagent_provenance",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'cli' WHEN 1 THEN 'subagent:thread_spawn' WHEN 2 THEN 'subagent'
        END AS thread_source, turn % 4 <> 0 AS is_subagent,
        CASE turn % 4 WHEN 1 THEN 'p' || conv_id WHEN 2 THEN 'q' || conv_id END AS parent_thread_id,
        CASE WHEN turn % 4 = 1 THEN CAST(turn AS VARCHAR) END AS subagent_depth FROM conversations"""
)
def subagent_provenance(spark, sf_dir):
    n, k = F.col("conv_id").cast("string"), F.col("turn") % 4
    source = F.when(k == 0, "cli").when(
        k == 1,
        F.concat(
            F.lit('{"subagent":{"thread_spawn":{"parent_thread_id":"p'),
            n,
            F.lit('","depth":'),
            F.col("turn").cast("string"),
            F.lit("}}}")
        )
    ).when(k == 2, F.concat(F.lit('{"subagent":{"parent_thread_id":"q'), n, F.lit('"}}'))).otherwise('{"sub_agent_kind":1}')
    return V.table(spark, sf_dir, "conversations").withColumn("s", source).select("conv_id", "turn", *N.subagent(F.col("s"))).select(
        "conv_id",
        "turn",
        "thread_source",
        "is_subagent",
        "parent_thread_id",
        "subagent_depth"
    )


_TITLE_CASES = """t AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN
    '<command-name>x</command-name><command-args> go  ' || conv_id || ' </command-args>' WHEN 2 THEN
    '<command-message>only</command-message>' WHEN 3 THEN '# AGENTS.md instructions for ' || conv_id ELSE ' ' || text
    END AS text, turn % 6 = 5 AS meta FROM conversations)"""


@register(
    "title_rules",
    f"""WITH {_TITLE_CASES} SELECT conv_id, turn,
        CASE WHEN meta THEN NULL ELSE CASE turn % 5 WHEN 1 THEN 'go ' || conv_id WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE
        nullif(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120), '') END END AS title FROM t"""
)
def title_rules(spark, sf_dir):
    from ..functions import text as T

    n, k = F.col("conv_id").cast("string"), F.col("turn") % 5
    text = F.when(k == 0, F.col("text")).when(
        k == 1,
        F.concat(F.lit("<command-name>x</command-name><command-args> go  "), n, F.lit(" </command-args>"))
    ).when(k == 2, "<command-message>only</command-message>").when(
        k == 3,
        F.concat(F.lit("# AGENTS.md instructions for "), n)
    ).otherwise(F.concat(F.lit(" "), "text"))
    return V.table(spark, sf_dir, "conversations").withColumn("t", text).select(
        "conv_id",
        "turn",
        T.command_title_of("t", F.col("turn") % 6 == 5).alias("title")
    )


@register(
    "title_overlay",
    with_views(
        "SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'second ' || id ELSE title END AS title FROM v_transcripts",
        "v_transcripts"
    )
)
def title_overlay(spark, sf_dir):
    s = V.transcripts(spark, sf_dir)
    own = s.where(F.col("id").cast("bigint") % 3 == 0)
    index = own.select("id", F.lit(1).alias("ord"), F.concat(F.lit("first "), "id").alias("title")).unionByName(
        own.select("id", F.lit(2).alias("ord"), F.concat(F.lit(" second  "), "id").alias("title"))
    ).unionByName(own.select("id", F.lit(3).alias("ord"), F.lit(" ").alias("title")))
    return N.titles_overlaid(s, index).select("id", "title")


@register(
    "import_validation",
    """SELECT conv_id, turn, CASE WHEN turn % 6 = 1 THEN 'unknown_source' WHEN turn % 6 = 2 THEN 'missing_source_id'
        WHEN turn % 6 = 3 THEN 'invalid_role' WHEN turn % 6 = 4 THEN 'missing_tool_name' WHEN turn % 6 = 5 THEN
        'invalid_status' END AS error FROM conversations"""
)
def import_validation(spark, sf_dir):
    k = F.col("turn") % 6
    rows = V.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(k == 1, "else").otherwise("project").alias("source"),
        F.when(k == 2, " ").otherwise("x").alias("source_id"),
        F.when(k == 3, "robot").otherwise(F.col("role")).alias("role"),
        F.when(k == 4, "").otherwise("tool").alias("tool_name"),
        F.when(k == 5, "odd").otherwise("success").alias("status")
    )
    return N.validated(rows, V.SOURCES, ["success", "error", "timeout"]).select("conv_id", "turn", "error")


@register("content_digest", "SELECT doc_id AS key, sha256(text) AS digest, strlen(text) AS bytes FROM documents")
def content_digest(spark, sf_dir):
    return N.digests(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content")))


@register(
    "project_path_resolution",
    """SELECT source AS folder, CASE WHEN min(k) = 0 THEN '/index/' || source WHEN min(k) = 1 THEN '/cwd/' ||
        min(doc_id) ELSE '/w/' || source END AS path FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) % 3 AS k
        FROM documents) GROUP BY source"""
)
def project_path_resolution(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").withColumn(
        "k",
        F.substring("source", 4, 9).cast("bigint") % 3
    ).withColumn("folder", F.concat(F.lit("-w-"), "source"))
    records = d.where("k <= 1").select(
        "folder",
        F.lit("f").alias("file"),
        F.lit(0).alias("ord"),
        F.col("doc_id"),
        F.to_json(F.struct(F.concat(F.lit("/cwd/"), F.col("doc_id").cast("string")).alias("cwd"))).alias("value")
    ).withColumn("file", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    index = d.where("k = 0").select("folder", F.concat(F.lit("/index/"), "source").alias("path")).distinct()
    return N.resolved_paths(d.select("folder").distinct(), index, records).select(F.substring("folder", 4, 99).alias("folder"), "path")


@register(
    "malformed_accounting",
    """SELECT source AS file, count(*) AS records, count(*) FILTER (doc_id % 9 = 4) AS malformed,
        arg_max(doc_id % 9 = 4, doc_id) AS incomplete_tail FROM documents GROUP BY source"""
)
def malformed_accounting(spark, sf_dir):
    whole = F.to_json(F.struct("doc_id"))
    d = V.table(spark, sf_dir, "documents").select(
        F.col("source").alias("file"),
        F.col("doc_id").alias("ord"),
        F.when(F.col("doc_id") % 9 == 4, F.expr("left(to_json(struct(doc_id)), 5)")).otherwise(whole).alias("value")
    )
    return jsonl.accounting(d).select("file", "records", "malformed", "incomplete_tail")


@register(
    "logs_array_transcripts",
    """SELECT '/g/' || conv_id % 10 || '/logs.json' AS file, CAST(conv_id AS VARCHAR) AS session_id,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence_num, role, trim(text) AS content
        FROM conversations"""
)
def logs_array_transcripts(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    entry = F.struct(
        F.col("conv_id").cast("string").alias("sessionId"),
        F.col("turn").alias("messageId"),
        F.col("role").alias("type"),
        F.col("text").alias("message")
    )
    files = c.groupBy(
        F.concat(F.lit("/g/"), (F.col("conv_id") % 10).cast("string"), F.lit("/logs.json")).alias("file")
    ).agg(F.to_json(F.collect_list(entry)).alias("value"))
    return N.log_transcripts(files).select("file", "session_id", "sequence_num", "role", "content")


_PANES = """p AS (SELECT event_id, 'box-' || user_id % 9 || CASE WHEN event_id % 4 = 0 THEN '-' || user_id % 5 ELSE ''
    END AS session, user_id % 4 AS window_index, event_id % 3 AS pane_index,
    CASE event_type WHEN 'click' THEN 'agent' WHEN 'view' THEN 'bash' ELSE 'sh' END AS command,
    event_type = 'error' AS pane_dead,
    CASE event_id % 6 WHEN 0 THEN 'x' || chr(10) || 'Goal blocked' WHEN 1 THEN 'Working (3s)' || chr(10) WHEN 2 THEN
    'goal achieved' || chr(10) || '   ' WHEN 3 THEN 'waiting for approval' || chr(10) || 'a' || chr(10) || 'b' ||
    chr(10) || 'c' WHEN 4 THEN 'plain' ELSE 'calling tool' || chr(10) || 'b' END AS captured_text,
    'm' || user_id % 3 AS machine, '/w/kit-Lib' || user_id % 3 || '/src' AS cwd FROM events)"""


def _panes(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    text = F.get(
        F.array(
            *[
                F.lit(x) for x in (
                    "x\nGoal blocked",
                    "Working (3s)\n",
                    "goal achieved\n   ",
                    "waiting for approval\na\nb\nc",
                    "plain",
                    "calling tool\nb"
                )
            ]
        ),
        (k % 6).cast("int")
    )
    session = F.concat(
        F.lit("box-"),
        (u % 9).cast("string"),
        F.when(k % 4 == 0, F.concat(F.lit("-"), (u % 5).cast("string"))).otherwise("")
    )
    command = F.when(F.col("event_type") == "click", "agent").when(F.col("event_type") == "view", "bash").otherwise("sh")
    told = e.select(
        "event_id",
        session.alias("session"),
        (u % 4).alias("window_index"),
        (k % 3).alias("pane_index"),
        command.alias("command"),
        (F.col("event_type") == "error").alias("pane_dead"),
        text.alias("captured_text"),
        F.concat(F.lit("m"), (u % 3).cast("string")).alias("machine"),
        F.concat(F.lit("/w/kit-Lib"), (u % 3).cast("string"), F.lit("/src")).alias("cwd")
    )
    return told.withColumn("window_name", F.col("session"))


_STATUS = "CASE WHEN pane_dead THEN 'dead' ELSE CASE event_id % 6 WHEN 0 THEN 'needs_attention' WHEN 1 THEN 'active' WHEN 2 THEN 'idle' WHEN 3 THEN 'needs_attention' WHEN 4 THEN CASE WHEN command = 'agent' THEN 'active' ELSE 'idle' END ELSE 'active' END END"


@register(
    "pane_status",
    f"""WITH {_PANES} SELECT event_id, {_STATUS} AS status, '/w/kit-Lib' || right(cwd[1:length(cwd) - 4], 1) AS path,
        'kit-lib' || right(cwd[1:length(cwd) - 4], 1) AS slug FROM p"""
)
def pane_status(spark, sf_dir):
    path, slug = P.project_of(F.col("cwd"), F.col("session"), "kit-")
    return P.classified(_panes(spark, sf_dir)).select("event_id", "status", path.alias("path"), slug.alias("slug"))


@register(
    "pane_summary",
    f"WITH {_PANES} SELECT machine, status, count(*) AS panes FROM (SELECT machine, {_STATUS} AS status FROM p) GROUP BY machine, status"
)
def pane_summary(spark, sf_dir):
    return P.fleet_summary(P.classified(_panes(spark, sf_dir)))


@register("pane_crash_candidates", f"""WITH {_PANES}, q AS (SELECT *, regexp_replace(regexp_replace(session,
    '[-_.]?\\d+$', ''), '[-_.]+$', '') AS prefix FROM p), alive AS (SELECT DISTINCT prefix, session FROM q
    WHERE NOT pane_dead AND command = 'agent' AND prefix <> session AND prefix <> '')
    SELECT session, window_index, status FROM (SELECT *, row_number() OVER (PARTITION BY session,
    window_index ORDER BY status = 'dead' DESC) AS n
    FROM (SELECT session, window_index, CASE WHEN pane_dead THEN 'dead' WHEN command IN ('bash',
    'sh') THEN 'crashed' END AS status FROM q WHERE EXISTS (FROM alive a
    WHERE a.prefix = q.prefix AND a.session <> q.session)) WHERE status IS NOT NULL) WHERE n = 1""")
def pane_crash_candidates(spark, sf_dir):
    return P.crash_candidates(_panes(spark, sf_dir)).select("session", "window_index", "status")


@register(
    "stream_ingest_equals_batch",
    """SELECT custkey, messages, tool_calls, mtime, path
        FROM (SELECT o_custkey AS custkey, o_orderkey % 7 AS messages, o_orderkey % 5 AS tool_calls,
        o_orderkey % 11 AS mtime, 'p' || o_orderkey AS path,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7 + o_orderkey % 5 DESC, o_orderkey % 7 DESC,
        o_orderkey % 11 DESC, 'p' || o_orderkey DESC) AS n FROM orders) WHERE n = 1"""
)
def stream_ingest_equals_batch(spark, sf_dir):
    """The orders as snapshots in three drops, streamed file by file into a bucketed table."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    rows = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"),
        (k % 7).alias("messages"),
        (k % 5).alias("tool_calls"),
        (k % 11).alias("mtime"),
        F.concat(F.lit("p"), k.cast("string")).alias("path"),
        (k % 3).alias("drop")
    )
    rows.repartition(3, "drop").drop("drop").write.parquet(f"{folder}/in")
    table = SnapshotTable(spark, f"{folder}/table", ["custkey"])
    stream_snapshots(spark, f"{folder}/in", rows.drop("drop").schema, table, f"{folder}/state", files_per_batch=1).awaitTermination()
    return table.read()


@register("snapshot_preference_any_order", "SELECT count(*) AS keys FROM (SELECT DISTINCT o_custkey FROM orders)")
def snapshot_preference_any_order(spark, sf_dir):
    """Merging in two halves gives the preferred snapshots of the whole; counts the keys for which it does."""
    k = F.col("o_orderkey")
    rows = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"),
        (k % 7).alias("messages"),
        (k % 5).alias("tool_calls"),
        (k % 11).alias("mtime"),
        F.concat(F.lit("p"), k.cast("string")).alias("path")
    )
    whole = O.preferred(rows, ["custkey"])
    odd, even = rows.where(F.substring("path", -1, 1).cast("int") % 2 == 1), rows.where(F.substring("path", -1, 1).cast("int") % 2 == 0)
    halves = O.preferred(O.preferred(odd, ["custkey"]).unionByName(O.preferred(even, ["custkey"])), ["custkey"])
    return whole.join(halves, whole.columns, "left_semi").agg(F.count("*").alias("keys"))
