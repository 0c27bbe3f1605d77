"""Raw records to transcripts, messages and tool calls. Records are (file, ord, value), value one JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Roles of stored messages.
ROLES = ["user", "assistant", "system", "tool", "info", "thinking"]
BLOCKS = "array<struct<type:string,text:string,thinking:string,content:string,id:string,name:string,input:string>>"


def field(path: str, value: str | Column = "value") -> Column:
    return F.get_json_object(value, f"$.{path}")


def number(path: str) -> Column:
    return F.coalesce(F.try_to_number(field(path), F.lit("999999999999999")).cast("bigint"), F.lit(0))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def json_of(value: str | Column = "value") -> Column:
    """A record as VARIANT, null where it is no JSON; unlike its text, it tells a string from what the string holds."""
    return F.try_parse_json(value)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}" if path else "$", "variant")


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def text_of(value: Column) -> Column:
    """The string that a VARIANT is, null for any other kind."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def given(value: Column) -> Column:
    """The VARIANT, or null for JSON's null."""
    return F.when(~F.is_variant_null(value), value)


#: Results within results that are followed; what lies deeper stays JSON.
DEPTH = 12


def flattened(content: Column, depth: int = DEPTH) -> Column:
    """The text of a content: a string as it is, or the parts of an array joined by line feeds and trimmed.

    A part is a string, or an object's text, else its thinking, else, of a tool result, the
    text of its content by the same rule. Numbers, objects and what is missing have no text.
    """
    blocks = F.try_variant_get(content, "$", "array<variant>")

    def said(b: Column) -> Column:
        inner = given(at(b, "content"))
        nested = flattened(inner, depth - 1) if depth else F.to_json(inner)
        told = F.when(is_text(b), text_of(b)).when(is_text(at(b, "text")), text_of(at(b, "text"))).when(
            is_text(at(b, "thinking")),
            text_of(at(b, "thinking"))
        )
        return told.when((text_of(at(b, "type")) == "tool_result") & inner.isNotNull(), nested)

    joined = F.array_join(F.filter(F.transform(blocks, said), lambda x: x.isNotNull()), "\n")
    return F.when(blocks.isNotNull(), T.trimmed(joined)).when(is_text(content), text_of(content)).otherwise("")


def mapped_role(role: Column) -> Column:
    """developer is system, reasoning is thinking, what is unknown is info."""
    return F.when(role == "developer", "system").when(role == "reasoning", "thinking").when(role.isin(*ROLES), role).otherwise("info")


def project_messages(records: DataFrame) -> DataFrame:
    """file, ord, sequence_num, id, source_id, role, content, model, tokens, timestamp of message records.

    ``raw`` is the JSON of contents that are arrays of blocks, null for all others.
    """
    told = records.where(field("type").isin("user", "assistant") & field("message").isNotNull())
    role = F.coalesce(field("message.role"), field("type"))
    told = told.withColumn("role", role).where(F.col("role").isin(*ROLES))
    told = told.withColumn("_content", at(json_of(), "message.content"))
    in_file = W.partitionBy("file").orderBy("ord")
    uuid = field("uuid")
    told = told.withColumn("uuid", uuid).withColumn("sequence_num", F.row_number().over(in_file) - 1)
    again = F.row_number().over(W.partitionBy("file", "uuid").orderBy("ord")) - 1
    told = told.withColumn("_again", F.when(F.col("uuid").isNotNull(), again))
    source_id = F.when(F.col("_again") > 0, F.concat_ws(":", "uuid", F.col("_again").cast("string"))).otherwise(F.col("uuid"))
    return told.select(
        "file", "ord", "sequence_num",
        F.concat_ws(":", "file", F.coalesce(source_id, F.col("sequence_num").cast("string"))).alias("id"),
        source_id.alias("source_id"),
        F.when(field("parentUuid").isNotNull(), F.concat_ws(":", "file", field("parentUuid"))).alias("parent_message_id"),
        "role",
        without_nul(flattened(F.col("_content"))).alias("content"),
        field("message.model").alias("model"),
        (field("isMeta") == "true").alias("is_meta"),
        *[number(f"message.usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")],
        field("timestamp").alias("timestamp"),
        F.when(F.try_variant_get("_content", "$", "array<variant>").isNotNull(), field("message.content")).alias("raw"),
    )


def tool_uses(messages: DataFrame) -> DataFrame:
    """message_id, file, n, tool_name, tool_input of the tool_use blocks of messages with ``raw`` content."""
    blocks = F.filter(F.from_json("raw", BLOCKS), lambda b: (b["type"] == "tool_use") & b["name"].isNotNull())
    told = messages.select(F.col("id").alias("message_id"), "file", F.posexplode(blocks).alias("n", "b"))
    return told.select("message_id", "file", "n", F.col("b.name").alias("tool_name"), F.col("b.input").alias("tool_input"))


def project_transcripts(records: DataFrame, messages: DataFrame) -> DataFrame:
    """One row a file: first cwd, branch and version, last model, first and last time in file order, title, token sums."""
    first = lambda path: F.min_by(F.when(field(path).isNotNull(), field(path)), F.when(field(path).isNotNull(), F.col("ord")))
    head = records.groupBy("file").agg(
        first("cwd").alias("project_path"),
        first("gitBranch").alias("git_branch"),
        first("version").alias("cli_version")
    )
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("ord"))
    title = F.when(F.col("role") == "user", T.command_title_of("content", F.coalesce("is_meta", F.lit(False))))
    body = messages.withColumn("_title", title).groupBy("file").agg(
        F.max_by("model", has("model")).alias("model"),
        F.min_by("timestamp", has("timestamp")).alias("started_at"),
        F.max_by("timestamp", has("timestamp")).alias("ended_at"),
        F.min_by("_title", has("_title")).alias("title"),
        F.count("*").alias("message_count"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
    )
    told = body.join(head, "file", "left")
    return told.withColumn("project_name", F.when(F.col("project_path").isNotNull(), F.substring_index("project_path", "/", -1)))


def rollout_messages(records: DataFrame) -> DataFrame:
    """file, ord, sequence_num, role, content of items other than calls; empty ones are dropped before numbering.

    Reasoning is told by its summary, or else its content.
    """
    kind = F.coalesce(field("payload.type"), F.lit(""))
    item = records.where(
        (field("type") == "response_item") & ~kind.isin("function_call", "function_call_output")
    ).withColumn("_payload", at(json_of(), "payload"))
    reasoning = kind == "reasoning"
    content = F.coalesce(F.when(reasoning, given(at(F.col("_payload"), "summary"))), at(F.col("_payload"), "content"))
    role = F.when(reasoning, "thinking").otherwise(mapped_role(text_of(at(F.col("_payload"), "role"))))
    told = item.select("file", "ord", role.alias("role"), flattened(content).alias("content"))
    return told.where("content <> ''").withColumn("sequence_num", F.row_number().over(W.partitionBy("file").orderBy("ord")) - 1)


def paired_calls(records: DataFrame) -> DataFrame:
    """file, call_id, ord, name, arguments, output: each output goes to the latest earlier call with its id; later outputs win."""
    kind = field("payload.type")
    output = F.when(kind == "function_call_output", flattened(at(json_of(), "payload.output")))
    told = records.where(kind.isin("function_call", "function_call_output"))
    return paired(
        told.select(
            "file",
            "ord",
            kind.alias("kind"),
            *[field(f"payload.{c}").alias(c) for c in ("call_id", "name", "arguments")],
            output.alias("output")
        )
    )


def paired(told: DataFrame) -> DataFrame:
    """As ``paired_calls``, from (file, ord, kind, call_id, name, arguments, output)."""
    is_call = F.col("kind") == "function_call"
    order = W.partitionBy("file", "call_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = told.withColumn("call", F.last(F.when(is_call, F.col("ord")), ignorenulls=True).over(order)).where("call is not null")
    return told.groupBy("file", "call_id", F.col("call").alias("ord")).agg(
        F.max_by("name", F.when(is_call, F.col("ord"))).alias("name"), F.max_by("arguments", F.when(is_call, F.col("ord"))).alias("arguments"), F.max_by("output", F.when(~is_call, F.col("ord"))).alias("output")
    )


def subagent(source: Column) -> list[Column]:
    """thread_source, is_subagent, parent_thread_id, depth, nickname, role, path from a plain or nested source."""
    at = lambda path: F.get_json_object(source, f"$.{path}")
    nested = source.startswith("{")
    either = lambda name: F.coalesce(at(f"subagent.thread_spawn.{name}"), at(f"subagent.{name}"))
    has = nested & at("subagent").isNotNull()
    similar = F.exists(F.json_object_keys(source), lambda k: F.contains(F.lower(F.replace(k, F.lit("_"), F.lit(""))), F.lit("subagent")))
    return [
        F.when(has & at("subagent.thread_spawn").isNotNull(), "subagent:thread_spawn").when(has, "subagent").when(~nested, source).alias("thread_source"),
        F.coalesce(F.when(has, True).when(nested, similar).otherwise(F.lower(source) == "subagent"), F.lit(False)).alias("is_subagent"),
        *[F.when(has, either(name)).alias(alias) for name, alias in (("parent_thread_id", "parent_thread_id"), ("depth", "subagent_depth"), ("agent_nickname", "agent_nickname"), ("agent_role", "agent_role"), ("agent_path", "agent_path"))],
    ]


def compact_metadata(texts: dict[str, Column], numbers: dict[str, Column] | None = None) -> Column:
    """A JSON object of the texts that are not empty and the numbers that are finite; {} where none is."""
    finite = lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    told = [F.when(x != "", x).alias(name) for name, x in texts.items()]
    told += [F.when(finite(x), x).alias(name) for name, x in (numbers or {}).items()]
    return F.to_json(F.struct(*told), {"ignoreNullFields": "true"})


def titles_overlaid(transcripts: DataFrame, index: DataFrame) -> DataFrame:
    """The latest valid title of an append-only side index (id, ord, title) wins over the derived one."""
    valid = index.where(F.trim("title") != "").groupBy("id").agg(F.max_by("title", "ord").alias("_title"))
    return transcripts.join(valid, "id", "left").withColumn("title", F.coalesce(T.session_title("_title"), "title")).drop("_title")


def log_transcripts(files: DataFrame) -> DataFrame:
    """file, session_id, sequence_num, role, content, timestamp of files that hold an array of entries."""
    entry = "array<struct<sessionId:string,messageId:long,type:string,message:string,timestamp:string>>"
    told = files.select("file", F.explode(F.from_json("value", entry)).alias("e"))
    session = F.coalesce("e.sessionId", F.regexp_replace(F.substring_index("file", "/", -1), r"\.json$", ""))
    order = W.partitionBy("file", "session_id").orderBy("messageId", "timestamp", "content")
    told = told.select(
        "file",
        session.alias("session_id"),
        "e.messageId",
        mapped_role(F.col("e.type")).alias("role"),
        F.trim("e.message").alias("content"),
        "e.timestamp"
    )
    return told.withColumn("sequence_num", F.row_number().over(order) - 1)


def validated(rows: DataFrame, sources: list[str], statuses: list[str]) -> DataFrame:
    """``rows`` (source, source_id, role, tool_name, status) with ``error``: null for good rows, else the first fault."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = (
        F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "unknown_source").when(empty("source_id"), "missing_source_id").when(F.col("role").isNotNull() & ~F.col("role").isin(*ROLES), "invalid_role")
        .when(F.col("tool_name").isNotNull() & empty("tool_name"), "missing_tool_name").when(F.col("status").isNotNull() & ~F.col("status").isin(*statuses), "invalid_status")
    )
    return rows.withColumn("error", error)


def resolved_paths(folders: DataFrame, index: DataFrame, records: DataFrame, first: int = 200) -> DataFrame:
    """folder, path: the index entry, else the first cwd of the first ``first`` records, else the decoded folder name."""
    cwd = records.where(F.col("ord") < first).withColumn("cwd", field("cwd")).where("cwd is not null").groupBy("folder").agg(
        F.min_by("cwd", F.struct("file", "ord")).alias("cwd")
    )
    bare = F.regexp_replace("folder", "^-", "")
    decoded = F.concat(F.when(F.col("folder").startswith("-"), "/").otherwise(""), F.replace(bare, F.lit("-"), F.lit("/")))
    told = folders.join(index.select("folder", F.col("path").alias("_index")), "folder", "left").join(cwd, "folder", "left")
    return told.select("folder", F.coalesce("_index", "cwd", decoded).alias("path"))


def digests(files: DataFrame) -> DataFrame:
    return files.select("key", F.sha2("content", 256).alias("digest"), F.octet_length("content").alias("bytes"))


def canonical_events(messages: DataFrame) -> DataFrame:
    """session_id, seq, type, content of the events of messages with ``raw`` block content."""
    none = [F.lit(None).cast("string").alias(c) for c in ("thinking", "content", "id", "name", "input")]
    whole = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), *none))
    blocks = F.when(F.col("raw").isNotNull(), F.from_json("raw", BLOCKS)).otherwise(whole)
    told = messages.select("session_id", "sequence_num", "role", F.posexplode(blocks).alias("k", "b"))
    kind = F.when(F.col("b.type") == "thinking", "thinking").when(F.col("b.type") == "tool_use", "tool_call").when(
        F.col("b.type") == "tool_result",
        "tool_result"
    ).otherwise(F.col("role"))
    order = W.partitionBy("session_id").orderBy("sequence_num", "k")
    return told.select(
        "session_id",
        (F.row_number().over(order) - 1).alias("seq"),
        kind.alias("type"),
        F.coalesce("b.text", "b.thinking", "b.content", "b.input", F.lit("")).alias("content"),
        F.col("b.name").alias("tool_name")
    )


def rollout_events(records: DataFrame) -> DataFrame:
    """session_id, seq, type, content, tool_name of a rollout's items: messages, reasoning, tool calls and their results.

    The session is the UUID at the end of the file's name, or else the name itself.
    """
    kind = field("payload.type")
    item = records.where(field("type") == "response_item").where(kind.isin("message", "reasoning", "function_call", "function_call_output"))
    parts = F.from_json(F.coalesce(field("payload.content"), field("payload.summary")), "array<struct<type:string,text:string>>")
    plain = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull() & (x != "")), "\n")
    role = mapped_role(field("payload.role"))
    type_ = F.when(kind == "reasoning", "thinking").when(kind == "function_call", "tool_call").when(
        kind == "function_call_output",
        "tool_result"
    ).otherwise(role)
    content = F.when(kind == "function_call", field("payload.arguments")).when(
        kind == "function_call_output",
        field("payload.output")
    ).otherwise(plain)
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.jsonl)?$", 1)
    uuid = F.regexp_extract(stem, r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$", 1)
    told = item.select(
        F.when(uuid != "", uuid).otherwise(stem).alias("session_id"),
        "ord",
        type_.alias("type"),
        F.coalesce(content, F.lit("")).alias("content"),
        field("payload.name").alias("tool_name")
    )
    told = told.where((F.trim("content") != "") | F.col("type").isin("tool_call", "tool_result"))
    return told.withColumn(
        "seq",
        F.row_number().over(W.partitionBy("session_id").orderBy("ord")) - 1
    ).select("session_id", "seq", "type", "content", "tool_name")


def events_summary(events: DataFrame) -> DataFrame:
    """session_id, events, user_events, tool_calls, last_type: what a discovery of outside transcripts reports."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("type") == "user").alias("user_events"),
        F.count_if(F.col("type") == "tool_call").alias("tool_calls"),
        F.max_by("type", "seq").alias("last_type")
    )


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    packed = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("c")))
    return F.substring(packed, F.lit(6), F.length(packed) - 6)


def native_lines(events: DataFrame, cwd: str = "/tmp", model: str = "unknown-model", titles: DataFrame | None = None) -> DataFrame:
    """session_id, n, line: a header, one JSON line an event and, for transcripts that ``titles`` (session_id, title) names, a title line.

    Tool calls keep their input, an object, or {} where it is none; results and system
    messages become texts of the assistant that say what they are.
    """
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    own = text('"sessionId":', quoted(F.col("session_id")), ',"cwd":', quoted(F.lit(cwd)))
    head = events.select("session_id").distinct().select(
        "session_id",
        F.lit(0).alias("n"),
        text('{"type":"header",', own, ',"version":"1.0.0"}').alias("line")
    )
    kind, name = F.col("type"), F.coalesce("tool_name", F.lit("unknown"))
    given = F.when(F.trim("content").startswith("{") & F.try_parse_json("content").isNotNull(), F.col("content")).otherwise("{}")
    said = lambda t: text('{"type":"text","text":', quoted(t), "}")
    block = F.when(kind == "thinking", text('{"type":"thinking","thinking":', quoted(F.col("content")), "}"))
    block = block.when(
        kind == "tool_call",
        text('{"type":"tool_use","id":"tool_', F.col("seq").cast("string"), '","name":', quoted(name), ',"input":', given, "}")
    )
    block = block.when(
        kind == "tool_result",
        said(F.concat(F.lit("[Tool: "), name, F.lit("]\n"), "content"))
    ).when(kind == "system", said(F.concat(F.lit("[System context]\n"), "content"))).otherwise(said(F.col("content")))
    line = F.when(kind == "user", text('{"type":"user",', own, ',"message":{"role":"user","content":', quoted(F.col("content")), "}}"))
    line = line.otherwise(
        text('{"type":"assistant",', own, ',"message":{"role":"assistant","content":[', block, '],"model":', quoted(F.lit(model)), "}}")
    )
    out = head.unionByName(events.select("session_id", (F.col("seq") + 1).alias("n"), line.alias("line")))
    if titles is None:
        return out
    last = events.groupBy("session_id").agg((F.max("seq") + 2).alias("n")).join(titles, "session_id").where("title <> ''")
    return out.unionByName(
        last.select("session_id", "n", text('{"type":"custom-title","customTitle":', quoted(F.col("title")), ",", own, "}").alias("line"))
    )


def canonical_json(record: str | Column) -> Column:
    """A JSON text with the keys of all objects in order, at every depth, and no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(record))


def record_digest(record: str | Column) -> Column:
    """SHA-256 of a record that the order of its keys doesn't change; the text itself counts where it is no JSON."""
    return F.sha2(F.coalesce(canonical_json(record), record if isinstance(record, Column) else F.col(record)), 256)
