"""Queries: discovery, side files, watch status, sync cycles, exports and imports, recounts, merges, packed vectors, digests."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators import store as O
from ..operators import transfer as X
from ..operators import vector, watch
from ..operators.materialize import checkpoint_folder
from ..sources import discovery
from ..streaming.sync import BoundedSync
from . import views as V
from .registry import register
from .views import NEAREST, with_views


def _folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "vectors_packed",
    """SELECT vec_id, 4 * len(embedding) AS bytes, len(embedding) AS dimensions,
        round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, true AS same FROM embeddings"""
)
def vectors_packed(spark, sf_dir):
    """Every vector packed to bytes and back."""
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vector.packed("embedding").alias("data"))
    e = e.withColumn("back", vector.unpacked("data"))
    total = F.aggregate("back", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return e.select(
        "vec_id",
        F.octet_length("data").alias("bytes"),
        F.size("back").alias("dimensions"),
        F.round(total, 6).alias("total"),
        (F.col("back") == F.col("embedding")).alias("same")
    )


@register("knn_packed", f"WITH {NEAREST} SELECT * FROM knn")
def knn_packed(spark, sf_dir):
    """Nearest neighbours over vectors that are stored as bytes."""
    e = V.table(spark, sf_dir, "embeddings")
    session = F.concat(F.lit("s"), (F.col("vec_id") % 100).cast("string"))
    held = e.select(F.col("vec_id").alias("message_id"), session.alias("session_id"), vector.packed("embedding").alias("embedding"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.nearest(held, asked)


_DAY = "CAST(DATE '2024-05-29' + CAST(conv_id % 6 AS INTEGER) AS DATE)"


@register("discover_days", f"SELECT {_DAY} AS day, conv_id || ':' || turn AS value FROM conversations WHERE conv_id % 6 BETWEEN 1 AND 4")
def discover_days(spark, sf_dir):
    """Turns written to folders by date, of which four days are read again."""
    root = _folder(spark, "days")
    c = V.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 6).alias("k"),
        F.concat_ws(":", "conv_id", "turn").alias("value")
    )
    first = dt.date(2024, 5, 29)
    for k in range(6):
        c.where(F.col("k") == k).select("value").write.text(f"{root}/{first + dt.timedelta(days=k):%Y/%m/%d}")
    told = discovery.dated_lines(spark, root, first + dt.timedelta(days=1), first + dt.timedelta(days=4), "part-*")
    return told.select(F.to_date(F.regexp_extract("file", r"/(\d{4}/\d{2}/\d{2})/[^/]*$", 1), "yyyy/MM/dd").alias("day"), "value")


@register("discover_projects", """SELECT folder, parent, CAST(sum(n) AS BIGINT) AS bytes
    FROM (SELECT 'p' || doc_id % 3 AS folder, CASE WHEN doc_id % 4 = 0 THEN 'agent0' END AS parent,
    length(CAST(doc_id AS VARCHAR)) + 1 AS n FROM documents WHERE doc_id % 4 < 3)
    GROUP BY folder, parent""")
def discover_projects(spark, sf_dir):
    """Transcripts right in project folders and one level below; those of one level more are none."""
    root = _folder(spark, "projects")
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("value"))
    k = F.col("doc_id") % 4
    for p in range(3):
        own = d.where(F.col("doc_id") % 3 == p)
        own.where(k.isin(1, 2)).select("value").write.mode("append").text(f"{root}/p{p}")
        own.where(k == 0).select("value").write.mode("append").text(f"{root}/p{p}/agent0")
        own.where(k == 3).select("value").write.mode("append").text(f"{root}/p{p}/agent0/deep")
    told = discovery.projects(spark, root, "part-*").where("size > 0")
    return told.groupBy("folder", "parent").agg(F.sum("size").alias("bytes"))


_SIDE = """f AS (SELECT event_type AS source, '/' || event_type || '/' || event_id AS path, event_id AS k,
    event_id % 97 AS mtime, event_id % 13 AS size,
    CASE event_type WHEN 'click' THEN '7:1' WHEN 'view' THEN '8:1' END AS signature FROM events),
    st AS (SELECT source, path, mtime, size,
    CASE event_type WHEN 'click' THEN '6:1' WHEN 'view' THEN '8:1' END AS signature, 'ok' AS status
    FROM (SELECT *, source AS event_type FROM f WHERE k % 3 <> 0))"""


@register(
    "side_file_gate",
    f"""WITH {_SIDE} SELECT f.source, f.path, CASE WHEN st.status IS NULL THEN 'new' WHEN st.mtime = f.mtime AND st.size
        = f.size AND st.signature IS NOT DISTINCT FROM f.signature THEN 'skip' ELSE 'changed' END AS action FROM f LEFT
        JOIN st USING (source, path)"""
)
def side_file_gate(spark, sf_dir):
    """The title index of one source is newer than when its files were read: they alone are changed."""
    e = V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.concat_ws("/", F.lit(""), "event_type", F.col("event_id").cast("string")).alias("path"),
        (F.col("event_id") % 97).alias("mtime"),
        (F.col("event_id") % 13).alias("size"),
        F.col("event_id").alias("k")
    )
    marks = lambda **told: spark.createDataFrame(list(told.items()), "source string, signature string")
    files = discovery.signed(e.drop("k"), marks(click="7:1", view="8:1"))
    state = discovery.signed(e.where("k % 3 <> 0").drop("k"), marks(click="6:1", view="8:1")).withColumn("status", F.lit("ok"))
    return O.file_gate(files, state)


_NOW = "2031-01-01 00:00:00"


@register("watch_status", f"""WITH f AS (SELECT event_type AS source, event_id AS k, ts, event_id % 13 AS size
    FROM events),
    gate AS (SELECT source, ts, k % 3 <> 0 AND k % 5 <> 0 AS done FROM f),
    r AS (SELECT event_type AS source, ts AS tried, CASE WHEN event_id % 6 <> 1 THEN ts + INTERVAL 5 SECOND END AS done,
    event_id % 7 AS skipped, CASE WHEN event_id % 6 = 2 THEN event_id % 3 ELSE 0 END AS failed,
    CASE WHEN event_id % 6 = 1 THEN 'boom ' || event_id END AS error FROM events WHERE event_type <> 'view'
    QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1),
    l AS (SELECT source, max(tried) AS last_attempt_at,
    max(done) FILTER (error IS NULL AND failed = 0) AS last_success_at, coalesce(arg_max(skipped,
    tried) FILTER (done IS NOT NULL), 0) AS skipped_files, (arg_max({{'e': coalesce(error,
    CASE WHEN failed > 0 THEN failed || CASE WHEN failed = 1 THEN ' file' ELSE ' files' END || ' failed to ingest'
    END)}}, tried)).e AS last_error FROM r GROUP BY source)
    SELECT g.source, ok, pending, lag_seconds, last_attempt_at, last_success_at, coalesce(skipped_files,
    0) AS skipped_files, last_error FROM (SELECT source, count(*) FILTER (done) AS ok,
    count(*) FILTER (NOT done) AS pending, greatest(CAST(floor(epoch(TIMESTAMP '{_NOW}') - epoch(max(ts) FILTER (NOT
    done))) AS BIGINT), 0) AS lag_seconds FROM gate GROUP BY source) g LEFT JOIN l USING (source)""")
def watch_status(spark, sf_dir):
    """Files by source, a third of them never read and a fifth changed since, and a log of attempts."""
    e, k = V.table(spark, sf_dir, "events"), F.col("event_id")
    files = e.select(
        F.col("event_type").alias("source"),
        k.cast("string").alias("path"),
        F.col("ts").alias("mtime"),
        (k % 13).alias("size"),
        k.alias("k")
    )
    state = files.where("k % 3 <> 0").withColumn(
        "size",
        F.when(F.col("k") % 5 == 0, -1).otherwise(F.col("size"))
    ).withColumn("status", F.lit("ok"))
    failed = F.when(k % 6 == 2, k % 3).otherwise(0)
    runs = e.where("event_type <> 'view'").groupBy("event_type", "ts").agg(F.min("event_id").alias("event_id"))
    runs = runs.select(
        F.col("event_type").alias("source"), F.col("ts").alias("attempted_at"), F.when(k % 6 != 1, F.col("ts") + F.expr("interval 5 seconds")).alias("completed_at"),
        (k % 7).alias("skipped"), failed.alias("failed"), F.when(k % 6 == 1, F.concat(F.lit("boom "), k.cast("string"))).alias("error"),
    )
    return watch.status(files.drop("k"), state.drop("k"), runs, F.to_timestamp(F.lit(_NOW)).cast(dict(e.dtypes)["ts"]))


@register("sync_cycles", with_views("""SELECT 0 AS cycle, id, title FROM (FROM v_transcripts ORDER BY started_at DESC
    NULLS LAST, id LIMIT 500)
    UNION ALL SELECT 2, id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'new ' || id ELSE title END
    FROM (FROM v_transcripts ORDER BY started_at DESC NULLS LAST, id LIMIT 500)""", "v_transcripts"))
def sync_cycles(spark, sf_dir):
    """Three cycles over the newest transcripts; nothing changes before the second, so it pushes nothing."""
    folder = _folder(spark, "sync")
    told = V.transcripts(spark, sf_dir).select("id", "title", "started_at")
    later = told.withColumn("title", F.when(F.col("id").cast("bigint") % 7 == 0, F.concat(F.lit("new "), "id")).otherwise(F.col("title")))
    for number, rows in enumerate((told, told, later)):
        push = lambda batch: batch.select(F.lit(number).alias("cycle"), "id", "title").write.mode("append").parquet(f"{folder}/pushed")  # noqa: B023, E731
        BoundedSync(spark, lambda: rows, push, folder).cycle(number)  # noqa: B023
    return spark.read.parquet(f"{folder}/pushed")


def _export_records(spark, sf_dir):
    """Lines of files in project folders, with the folder as cwd; some are broken."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = (c % 7).cast("string")
    line = F.concat(
        F.lit('{"a":{"cwd":"/old/p'),
        name,
        F.lit('/x y"},"say":"\\"cwd\\":\\"/old/p1\\"","n":'),
        k.cast("string"),
        F.lit(',"cwd":"/old/p'),
        name,
        F.lit('"}')
    )
    value = F.when(k % 11 == 0, F.lit('{"cwd":"/old/p1')).otherwise(line)
    return V.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("-old-p"), name).alias("project"),
        F.concat(F.lit("a/b+c%"), (c % 50).cast("string"), F.lit(".jsonl")).alias("file"),
        k.alias("ord"),
        value.alias("value")
    )


_LINES = """r AS (SELECT '-old-p' || o_custkey % 7 AS project, 'a/b+c%' || o_custkey % 50 || '.jsonl' AS file,
    o_orderkey AS k, o_custkey % 7 AS p, row_number() OVER (PARTITION BY o_custkey % 7,
    o_custkey % 50 ORDER BY o_orderkey) - 1 AS ord, o_orderkey % 11 = 0 AS bad,
    CASE WHEN o_orderkey % 11 = 0 THEN '{"cwd":"/old/p1' ELSE '{"a":{"cwd":"/old/p' || o_custkey % 7 ||
    '/x y"},"say":"\\"cwd\\":\\"/old/p1\\"","n":' || o_orderkey || ',"cwd":"/old/p' || o_custkey % 7 || '"}' END AS
    value FROM orders)"""


@register(
    "export_files",
    f"""WITH {_LINES} SELECT project, count(DISTINCT project || file) AS files,
        CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes FROM r WHERE p < 5 GROUP BY ROLLUP (project)"""
)
def export_files(spark, sf_dir):
    """Five of seven projects, written; the manifest of what lies on disk."""
    records = _export_records(spark, sf_dir)
    chosen = records.select("project").distinct().where("right(project, 1) < '5'")
    return X.export(records, _folder(spark, "export"), chosen)


def _imported(spark, sf_dir, overwrite):
    folder = _folder(spark, "export")
    X.export(_export_records(spark, sf_dir), folder)
    existing = spark.createDataFrame(
        [("-new-q", "a/b+c%3.jsonl"), ("-old-p2", "a/b+c%2.jsonl"), ("-new-q", "else")],
        "project string, file string"
    )
    return X.imported(spark, folder, existing, "/old/p1", "/new/q", overwrite)


_TO = "CASE WHEN p = 1 THEN '-new-q' ELSE project END"
_KNOWN = f"({_TO} || '|' || file) IN ('-new-q|a/b+c%3.jsonl', '-old-p2|a/b+c%2.jsonl')"


@register(
    "import_files",
    f"""WITH {_LINES} SELECT {_TO} AS project, file, ord,
        CASE WHEN p = 1 THEN '{{"a":{{"cwd":"/new/q/x y"}},"say":"\\"cwd\\":\\"/old/p1\\"","n":' || k ||
        ',"cwd":"/new/q"}}' ELSE value END AS value FROM r WHERE NOT bad AND NOT ({_KNOWN})"""
)
def import_files(spark, sf_dir):
    """An export brought in under another prefix; files that are there are skipped."""
    return _imported(spark, sf_dir, False)[0]


@register(
    "import_outcome",
    f"""WITH {_LINES} SELECT {_TO} AS project, file,
        CASE WHEN {_KNOWN} THEN 'overwritten' WHEN p = 1 THEN 'remapped' ELSE 'imported' END AS action,
        count(*) AS lines, count(*) FILTER (bad) AS bad_lines FROM r GROUP BY ALL"""
)
def import_outcome(spark, sf_dir):
    """What an import does with each file when it may overwrite, and how many lines it puts aside."""
    return _imported(spark, sf_dir, True)[2]


@register(
    "import_content",
    with_views(
        """SELECT s.id, CASE WHEN k THEN 'in ' || s.id ELSE title END AS title,
            CAST(CASE WHEN k THEN 1 ELSE n END AS BIGINT) AS messages
            FROM (SELECT *, CAST(id AS BIGINT) % 5 = 0 AND CAST(id AS BIGINT) % 3 > 0 AS k FROM v_transcripts) s
            JOIN (SELECT session_id, count(*) AS n FROM v_messages GROUP BY session_id) m ON m.session_id = s.id""",
        "v_transcripts",
        "v_messages"
    )
)
def import_content(spark, sf_dir):
    """Payloads for a fifth of the transcripts; those with a row at fault change nothing."""
    n = F.col("id").cast("bigint")
    store = {"transcripts": V.transcripts(spark, sf_dir), "messages": V.messages(spark, sf_dir), "tool_calls": V.tool_calls(spark, sf_dir)}
    new = store["transcripts"].where(n % 5 == 0).withColumn("title", F.concat(F.lit("in "), "id"))
    said = new.select(
        F.concat("id", F.lit(":new")).alias("id"),
        F.col("id").alias("session_id"),
        F.lit("user").alias("role"),
        F.lit("hello").alias("content"),
        F.lit(0).cast("bigint").alias("sequence_num")
    )
    rows = new.select(
        "id",
        "source",
        "source_id",
        F.when(n % 3 == 0, "robot").otherwise("user").alias("role"),
        F.lit(None).cast("string").alias("tool_name"),
        F.lit(None).cast("string").alias("status")
    )
    errors = N.validated(rows, V.SOURCES, ["success", "error", "timeout"]).select("id", "error")
    out, _ = X.content_imported(store, {"transcripts": new, "messages": said, "tool_calls": store["tool_calls"].limit(0)}, errors)
    count = out["messages"].groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"))
    return out["transcripts"].join(count, "id").select("id", "title", "messages")


def _parts(spark, sf_dir):
    """Orders as transcripts, their lines as messages and tool calls."""
    o = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit(-1).cast("bigint").alias("message_count"),
        F.lit(-1).cast("bigint").alias("tool_call_count"),
        F.lit(-1).cast("bigint").alias("total_input_tokens"),
        F.lit(-1).cast("bigint").alias("total_output_tokens")
    )
    lines = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").cast("bigint").alias("input_tokens"),
        (F.col("l_suppkey") % 5).alias("output_tokens")
    )
    return o, lines.where("output_tokens <> 1"), lines.where("output_tokens = 1")


@register("recount_touched", """SELECT o_orderkey AS id, CASE WHEN k THEN coalesce(n, 0) ELSE -1 END AS message_count,
    CASE WHEN k THEN coalesce(c, 0) ELSE -1 END AS tool_call_count,
    CASE WHEN NOT k THEN -1 WHEN o_orderkey % 6 = 0 THEN 1000 ELSE coalesce(i, 0) END AS total_input_tokens,
    CASE WHEN k THEN coalesce(o, 0) ELSE -1 END AS total_output_tokens
    FROM (SELECT *, o_orderkey % 3 = 0 AS k FROM orders) LEFT
    JOIN (SELECT l_orderkey AS id, count(*) FILTER (l_suppkey % 5 <> 1) AS n, count(*) FILTER (l_suppkey % 5 = 1) AS c,
    CAST(sum(l_linenumber) FILTER (l_suppkey % 5 <> 1) AS BIGINT) AS i,
    CAST(sum(l_suppkey % 5) FILTER (l_suppkey % 5 <> 1) AS BIGINT) AS o FROM lineitem
    GROUP BY l_orderkey) x ON x.id = o_orderkey""")
def recount_touched(spark, sf_dir):
    """Counts and totals of a third of the transcripts, some with a total of their own."""
    transcripts, messages, calls = _parts(spark, sf_dir)
    touched = transcripts.where("id % 3 = 0").select(
        "id",
        F.when(F.col("id") % 6 == 0, F.lit(1000).cast("bigint")).alias("total_input_tokens")
    )
    return O.recounted(transcripts, messages, calls, touched)


def _two_stores(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    k, o = F.col("c_custkey"), V.table(spark, sf_dir, "orders")
    box = lambda n: F.concat(F.lit("m"), (k % n).cast("string")).alias("machine")
    first = c.where("c_custkey % 3 < 2").select(k.alias("id"), F.lit("a").alias("source"), k.cast("string").alias("source_id"), box(4))
    # a third of the source is known by id, a third by natural key, the rest is new
    second = c.select(
        F.when(k % 3 == 1, k + 1_000_000).otherwise(k).alias("id"),
        F.lit("a").alias("source"),
        k.cast("string").alias("source_id"),
        box(5)
    )
    said = lambda shift, keep: o.where(keep).select((F.col("o_orderkey") * 10 + shift).alias("id"), (F.col("o_custkey") + F.when((F.col("o_custkey") % 3 == 1) & F.lit(shift > 0), 1_000_000).otherwise(0)).alias("session_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("source_id"))
    machines = spark.createDataFrame([("m0", 99), ("m9", 7)], "name string, session_count long")
    return {
        "transcripts": first, "messages": said(0, "o_orderkey % 5 < 3 and o_custkey % 3 < 2"), "machines": machines
    }, {"transcripts": second, "messages": said(1, "o_orderkey % 5 > 0")}


_TWO = """t AS (SELECT c_custkey AS k, 'm' || c_custkey % 4 AS machine FROM customer WHERE c_custkey % 3 < 2
    UNION ALL SELECT c_custkey, 'm' || c_custkey % 5 FROM customer WHERE c_custkey % 3 = 2),
    added AS (SELECT * FROM orders WHERE o_orderkey % 5 > 0 AND NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 < 3 AND
    o_custkey % 3 < 2) AND o_custkey IN (SELECT c_custkey FROM customer))"""


@register(
    "merge_report",
    f"""WITH {_TWO} SELECT 'transcripts' AS tab, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 2) AS added
        UNION ALL SELECT 'messages', (SELECT count(*) FROM added)"""
)
def merge_report(spark, sf_dir):
    """How many rows one store brings into another that knows two thirds of its transcripts."""
    return O.merge_report(O.stores_merged(*_two_stores(spark, sf_dir))[1])


@register(
    "merge_machines",
    f"""WITH {_TWO} SELECT coalesce(t.machine, r.name) AS name, coalesce(t.n, r.n) AS session_count
        FROM (SELECT machine, count(*) AS n FROM t GROUP BY machine) t FULL
        JOIN (VALUES ('m0', 99), ('m9', 7)) r(name, n) ON r.name = t.machine"""
)
def merge_machines(spark, sf_dir):
    """The machines of the merged store, recounted."""
    return O.stores_merged(*_two_stores(spark, sf_dir))[0]["machines"]


@register(
    "record_digest",
    """SELECT conv_id, turn, sha256('{"a":[{"x":1,"y":{"p":' || CAST(to_json(text) AS VARCHAR) || ',"q":[]}},' || turn
        || '],"b":{"c":null,"d":true},"role":"' || role || '"}') AS digest FROM conversations"""
)
def record_digest(spark, sf_dir):
    """Digests of nested records whose keys stand in either order."""
    c = V.table(spark, sf_dir, "conversations")
    said = F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9)
    one = F.concat(
        F.lit('{ "role":"'),
        "role",
        F.lit('", "b": {"d":true,"c":null},"a":[{"y":{"q":[],"p":'),
        said,
        F.lit('},"x":1}, '),
        F.col("turn").cast("string"),
        F.lit("]}")
    )
    two = F.concat(
        F.lit('{"a":[{"x":1,"y":{"p":'),
        said,
        F.lit(',"q":[]}},'),
        F.col("turn").cast("string"),
        F.lit('],"b":{"c":null,"d":true},"role":"'),
        "role",
        F.lit('"}')
    )
    return c.select("conv_id", "turn", N.record_digest(F.when(F.col("turn") % 2 == 0, one).otherwise(two)).alias("digest"))


@register(
    "import_matching",
    f"""WITH {_LINES} SELECT project, file, 'imported' AS action, count(*) AS lines, count(*) FILTER (bad) AS bad_lines
        FROM r WHERE p IN (3) GROUP BY ALL"""
)
def import_matching(spark, sf_dir):
    """An import of the projects whose name holds a text."""
    folder = _folder(spark, "export")
    X.export(_export_records(spark, sf_dir), folder)
    return X.imported(spark, folder, spark.createDataFrame([], "project string, file string"), holding="OLD-p3")[2]


@register(
    "compact_metadata",
    """SELECT event_id, '{' || concat_ws(',', '"kind":"' || event_type || '"',
        CASE WHEN event_id % 3 = 0 THEN '"note":"n"' END, CASE WHEN event_id % 4 > 1 THEN '"depth":' || event_id END,
        CASE WHEN event_id % 5 = 0 THEN '"share":0.5' END) || '}' AS metadata FROM events"""
)
def compact_metadata(spark, sf_dir):
    """Metadata without empty texts and numbers that are null, infinite or none at all."""
    k = F.col("event_id")
    note = F.when(k % 3 == 0, "n").when(k % 3 == 1, "")
    share = F.when(k % 5 == 0, 0.5).when(k % 5 == 1, float("nan")).when(k % 5 == 2, float("-inf"))
    told = N.compact_metadata({"kind": F.col("event_type"), "note": note}, {"depth": F.when(k % 4 > 1, k), "share": share})
    return V.table(spark, sf_dir, "events").select("event_id", told.alias("metadata"))
