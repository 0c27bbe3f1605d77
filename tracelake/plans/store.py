"""Queries: store maintenance, ingest gates, export, backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panes as P
from ..operators import store as O
from . import views as V
from .listing import _WANTED, wanted_identifiers
from .registry import register
from .views import with_views


def _orders(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("title"),
        F.col("o_totalprice").alias("total")
    )


@register("upsert_transcripts", """SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title,
    coalesce(n.total, o.total) AS total FROM
    (SELECT o_orderkey AS id, o_orderstatus AS title, o_totalprice AS total FROM orders
    WHERE o_orderkey % 3 <> 0) o FULL JOIN
    (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'new' END AS title, o_totalprice + 1 AS total
    FROM orders WHERE o_orderkey % 2 = 0) n ON o.id = n.id""")
def upsert_transcripts(spark, sf_dir):
    o = _orders(spark, sf_dir).drop("custkey")
    new = o.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 != 0, "new").alias("title"), (F.col("total") + 1).alias("total"))
    return O.upserted(o.where("id % 3 <> 0"), new, ["id"], ["id"])


@register("replace_children", """SELECT session_id, CAST(count(*) AS BIGINT) AS children, round(CAST(sum(q) AS DOUBLE),
    2) AS quantity FROM (SELECT l_orderkey AS session_id, l_quantity AS q FROM lineitem WHERE l_orderkey % 5 <> 0
    UNION ALL SELECT l_orderkey, l_quantity * 2 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber <= 2)
    GROUP BY session_id""")
def replace_children(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("n"),
        F.col("l_quantity").cast("double").alias("q")
    )
    new = lines.where("session_id % 5 = 0 and n <= 2").withColumn("q", F.col("q") * 2)
    # a touched parent without a new child keeps none
    told = O.children_replaced(lines, new, "session_id").where("session_id % 5 <> 0 or n <= 2")
    return told.groupBy("session_id").agg(F.count("*").alias("children"), F.round(F.sum("q"), 2).alias("quantity"))


@register("preferred_snapshot", """SELECT custkey, messages, tool_calls, mtime, path
    FROM (SELECT o_custkey AS custkey, o_orderkey % 7 AS messages, o_orderkey % 5 AS tool_calls,
    o_orderkey % 11 AS mtime, 'p' || o_orderkey AS path,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7 + o_orderkey % 5 DESC, o_orderkey % 7 DESC,
    o_orderkey % 11 DESC, 'p' || o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def preferred_snapshot(spark, sf_dir):
    k = F.col("id")
    snapshots = _orders(spark, sf_dir).select(
        "custkey",
        (k % 7).alias("messages"),
        (k % 5).alias("tool_calls"),
        (k % 11).alias("mtime"),
        F.concat(F.lit("p"), k.cast("string")).alias("path")
    )
    return O.preferred(snapshots, ["custkey"])


@register("shrink_guard", """SELECT i.k, CASE WHEN s.k IS NULL THEN 'new' WHEN NOT (i.messages < s.messages OR
    i.tool_calls < s.tool_calls) THEN 'accept' WHEN i.intent AND i.reason <> '' THEN 'accept_shrink' ELSE 'refuse' END
    AS verdict FROM
    (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber <> 2) AS messages,
    count(*) FILTER (l_linenumber < 4) AS tool_calls, l_orderkey % 3 = 0 AS intent,
    CASE WHEN l_orderkey % 2 = 0 THEN 'asked' ELSE ' ' END AS reason_,
    trim(CASE WHEN l_orderkey % 2 = 0 THEN 'asked' ELSE ' ' END) AS reason FROM lineitem GROUP BY l_orderkey) i
    LEFT JOIN (SELECT l_orderkey AS k, count(*) AS messages, count(*) FILTER (l_linenumber < 4) AS tool_calls
    FROM lineitem WHERE l_orderkey % 10 <> 7 GROUP BY l_orderkey) s ON s.k = i.k""")
def shrink_guard(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    stored = lines.where("k % 10 <> 7").groupBy("k").agg(F.count("*").alias("messages"), F.count_if(F.col("n") < 4).alias("tool_calls"))
    new = lines.groupBy("k").agg(F.count_if(F.col("n") != 2).alias("messages"), F.count_if(F.col("n") < 4).alias("tool_calls"))
    new = new.withColumn("intent", F.col("k") % 3 == 0).withColumn("reason", F.when(F.col("k") % 2 == 0, "asked").otherwise(" "))
    return O.shrink_verdicts(stored, new, "k")


_SLICES = """t AS (SELECT o_orderkey AS id, o_orderstatus AS source,
    CAST(o_orderkey // 2 AS VARCHAR) || o_orderstatus AS source_id FROM orders WHERE o_orderkey % 3 = 0),
    s AS (SELECT o_orderkey AS id, o_orderstatus AS source,
    CAST(o_orderkey // 2 AS VARCHAR) || o_orderstatus AS source_id FROM orders
    WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 1)"""


def _slices(spark, sf_dir):
    o = _orders(spark, sf_dir).select(
        "id",
        F.col("title").alias("source"),
        F.concat(F.floor(F.col("id") / 2).cast("string"), "title").alias("source_id")
    )
    return o.where("id % 3 = 0"), o.where("id % 2 = 0 or id % 3 = 1")


@register(
    "merge_stores",
    f"""WITH {_SLICES} SELECT *, 'target' AS origin FROM t UNION ALL SELECT *, 'source' FROM s WHERE NOT EXISTS (FROM t
        WHERE t.id = s.id) AND NOT EXISTS (FROM t WHERE t.source = s.source AND t.source_id = s.source_id)"""
)
def merge_stores(spark, sf_dir):
    return O.merged_stores(*_slices(spark, sf_dir))


@register(
    "merge_children",
    f"""WITH {_SLICES}, ids AS (SELECT s.id, coalesce(min(t.id), s.id) AS to_id FROM s LEFT
        JOIN t USING (source, source_id) GROUP BY s.id) SELECT to_id AS session_id, count(*) AS children FROM lineitem
        JOIN ids ON ids.id = l_orderkey GROUP BY to_id"""
)
def merge_children(spark, sf_dir):
    target, source = _slices(spark, sf_dir)
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("n"))
    return O.merged_children(target, source, lines).groupBy("session_id").agg(F.count("*").alias("children"))


@register(
    "machine_register",
    with_views(
        """SELECT machine AS name, min(started_at) AS first_seen_at, max(started_at) AS last_seen_at,
            count(*) AS session_count FROM v_transcripts WHERE machine IS NOT NULL GROUP BY machine""",
        "v_transcripts"
    )
)
def machine_register(spark, sf_dir):
    return O.register_machines(
        V.transcripts(spark, sf_dir).where("machine is not null").select(
            F.col("machine").alias("name"),
            F.col("started_at").alias("seen_at")
        )
    )


@register(
    "project_index_merge",
    """SELECT c_custkey AS session_id, 'new' AS entry FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0"""
)
def project_index_merge(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    new, old = c.where("session_id % 2 = 0").withColumn("entry", F.lit("new")), c.where("session_id % 3 = 0").withColumn("entry", F.lit("old"))
    return O.index_merged(old, new)


@register(
    "delete_cascade",
    with_views(
        """SELECT 'transcripts' AS tab, count(*) AS n FROM v_transcripts WHERE CAST(id AS BIGINT) % 4 <> 1
            UNION ALL SELECT 'messages', count(*) FROM v_messages WHERE CAST(session_id AS BIGINT) % 4 <> 1
            UNION ALL SELECT 'tool_calls', count(*) FROM v_tool_calls
            WHERE NOT (CAST(session_id AS BIGINT) % 4 = 1 AND session_id IN (SELECT id FROM v_transcripts))""",
        "v_transcripts",
        "v_messages",
        "v_tool_calls"
    )
)
def delete_cascade(spark, sf_dir):
    s, m, c = V.transcripts(spark, sf_dir), V.messages(spark, sf_dir), V.tool_calls(spark, sf_dir)
    gone = s.where(F.col("id").cast("bigint") % 4 == 1).select(F.col("id").alias("session_id"))
    left = O.delete_cascade({"transcripts": (s, "id"), "messages": (m, "session_id"), "tool_calls": (c, "session_id")}, gone)
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "rename",
    with_views(
        "SELECT id, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'Renamed ' || id ELSE title END AS title FROM v_transcripts",
        "v_transcripts"
    )
)
def rename(spark, sf_dir):
    s = V.transcripts(spark, sf_dir)
    return O.renamed(
        s,
        s.where(F.col("id").cast("bigint") % 6 == 0).select("id", F.concat(F.lit("Renamed "), "id").alias("title"))
    ).select("id", "title")


@register("relocate_paths", with_views("""SELECT id, CASE WHEN project_path = '/w/src1' OR starts_with(project_path,
    '/w/src1/') THEN '/home/x' || substr(project_path, 8) ELSE project_path END AS project_path,
    replace(CASE WHEN p = '/w/src1' OR starts_with(p, '/w/src1/') THEN '/home/x' || substr(p, 8) ELSE p END,
    '/-w-src1/', '/-home-x/') AS source_path FROM (SELECT *,
    CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN project_path || '/f.jsonl' ELSE '/state/' || replace(project_path, '/',
    '-') || '/f.jsonl' END AS p FROM v_transcripts)""", "v_transcripts"))
def relocate_paths(spark, sf_dir):
    s = V.transcripts(spark, sf_dir)
    path = F.when(F.col("id").cast("bigint") % 2 == 0, F.concat("project_path", F.lit("/f.jsonl"))).otherwise(
        F.concat(F.lit("/state/"), F.replace("project_path", F.lit("/"), F.lit("-")), F.lit("/f.jsonl"))
    )
    return O.relocated(s.withColumn("source_path", path), "/w/src1", "/home/x").select("id", "project_path", "source_path")


@register("remap_prefix", with_views("SELECT id, replace(content, ' la ', ' LA ') AS content FROM v_messages", "v_messages"))
def remap_prefix(spark, sf_dir):
    return V.messages(spark, sf_dir).select("id", O.remapped_text(F.col("content"), " la ", " LA ", False).alias("content"))


@register(
    "remap_bounded",
    """SELECT doc_id, replace(replace(replace('{"cwd":"/w/src1","a":"/w/src1/x","b":"/w/src10","c":"/w/' || source ||
        '"}', '/w/src1"', '/home/$1"'), '/w/src1/', '/home/$1/'), '/w/src1 ', '/home/$1 ') AS text FROM documents"""
)
def remap_bounded(spark, sf_dir):
    text = F.concat(F.lit('{"cwd":"/w/src1","a":"/w/src1/x","b":"/w/src10","c":"/w/'), F.col("source"), F.lit('"}'))
    return V.table(spark, sf_dir, "documents").select("doc_id", O.remapped_text(text, "/w/src1", "/home/$1", True).alias("text"))


@register(
    "matching_folders",
    """SELECT doc_id, folder FROM (SELECT doc_id,
        '-w-' || source || CASE WHEN doc_id % 3 = 0 THEN '-sub' ELSE '' END AS folder FROM documents)
        WHERE folder = '-w-src1' OR starts_with(folder, '-w-src1-')"""
)
def matching_folders(spark, sf_dir):
    folder = F.concat(F.lit("-w-"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, "-sub").otherwise(""))
    return O.matching_folders(V.table(spark, sf_dir, "documents").select("doc_id", folder.alias("folder")), "/w/src1")


@register(
    "rename_by_identifier",
    with_views(
        """SELECT s.id, coalesce(t.title, s.title) AS title FROM v_transcripts s LEFT
            JOIN (SELECT candidates AS id, min('New ' || identifier) AS title FROM told WHERE matches = 1
            GROUP BY candidates) t ON t.id = s.id""",
        "v_transcripts",
        ctes=_WANTED
    )
)
def rename_by_identifier(spark, sf_dir):
    titles = wanted_identifiers(spark, sf_dir).select("identifier", F.concat(F.lit("New "), "identifier").alias("title"))
    return O.renamed_by(V.transcripts(spark, sf_dir), titles).select("id", "title")


def _files(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.concat_ws("/", F.lit(""), "event_type", F.col("event_id").cast("string")).alias("path"),
        F.col("event_id").alias("k")
    )
    files = e.select("source", "path", (F.col("k") % 97).alias("mtime"), (F.col("k") % 13).alias("size"))
    state = e.where("k % 3 <> 0").select(
        "source",
        "path",
        (F.col("k") % 97 - F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("mtime"),
        (F.col("k") % 13).alias("size"),
        F.when(F.col("k") % 7 == 0, "error").when(F.col("k") % 11 == 0, "pending").otherwise("ok").alias("status")
    )
    return files, state


_FILES = """f AS (SELECT event_type AS source, '/' || event_type || '/' || event_id AS path, event_id AS k,
    event_id % 97 AS mtime, event_id % 13 AS size FROM events),
    st AS (SELECT source, path, mtime - CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS mtime, size,
    CASE WHEN k % 7 = 0 THEN 'error' WHEN k % 11 = 0 THEN 'pending' ELSE 'ok' END AS status FROM f WHERE k % 3 <> 0),
    gate AS (SELECT f.source, f.path, f.mtime, st.status,
    CASE WHEN st.status IS NULL THEN 'new' WHEN st.status = 'ok' AND st.mtime = f.mtime AND st.size = f.size THEN 'skip'
    WHEN st.status = 'ok' THEN 'changed' ELSE 'retry' END AS action FROM f LEFT
    JOIN st ON st.source = f.source AND st.path = f.path)"""


@register("file_state_gate", f"WITH {_FILES} SELECT source, path, action FROM gate")
def file_state_gate(spark, sf_dir):
    return O.file_gate(*_files(spark, sf_dir))


@register(
    "watch_lag",
    f"""WITH {_FILES} SELECT source, count(*) FILTER (action = 'skip') AS ok,
        count(*) FILTER (action <> 'skip') AS pending, count(*) FILTER (status = 'error') AS errors,
        max(mtime) FILTER (action <> 'skip') AS newest_pending FROM gate GROUP BY source"""
)
def watch_lag(spark, sf_dir):
    return O.watch_status(*_files(spark, sf_dir))


@register(
    "ingest_result",
    f"""WITH {_FILES} SELECT source, count(*) AS scanned, count(*) FILTER (action <> 'skip') AS ingested,
        count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'retry') AS retried FROM gate
        GROUP BY source"""
)
def ingest_result(spark, sf_dir):
    return O.ingest_result(O.file_gate(*_files(spark, sf_dir)))


@register(
    "latest_file_state",
    """SELECT o_orderstatus AS source, 'p' || o_custkey AS path, arg_max(o_orderkey % 97, o_orderkey) AS mtime,
        arg_max(o_orderkey % 13, o_orderkey) AS size, arg_max(o_orderpriority, o_orderkey) AS status FROM orders
        GROUP BY ALL"""
)
def latest_file_state(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return O.latest_state(
        o.select(
            F.col("o_orderstatus").alias("source"),
            F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("path"),
            (k % 97).alias("mtime"),
            (k % 13).alias("size"),
            F.col("o_orderpriority").alias("status"),
            k.alias("ingested_at"),
            F.lit(1).alias("run")
        )
    )


@register(
    "export_manifest",
    "SELECT source AS project, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)"
)
def export_manifest(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return O.export_manifest(d.select(F.col("source").alias("project"), F.octet_length("text").cast("bigint").alias("bytes")))


@register("import_remap", """SELECT doc_id, CASE WHEN path = '/old/src1' OR starts_with(path,
    '/old/src1/') THEN '/new/src1' || substr(path, 10) ELSE path END AS path,
    CASE WHEN doc_id % 4 = 0 THEN 'skipped' WHEN starts_with(path,
    '/old/src1/') THEN 'remapped' ELSE 'imported' END AS action
    FROM (SELECT doc_id, '/old/' || source || '/' || doc_id AS path FROM documents)""")
def import_remap(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", F.lit("/old"), "source", F.col("doc_id").cast("string")).alias("path")
    )
    return O.import_report(d, d.where("doc_id % 4 = 0"), "doc_id", "/old/src1", "/new/src1")


def _inventory(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    key = F.concat_ws(":", "source", (F.col("doc_id") % 400).cast("string"))
    files = d.select(
        key.alias("key"),
        F.concat(F.lit("/f/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        F.sha2("text", 256).alias("digest"),
        F.when(F.col("doc_id") % 50 == 7, "broken").alias("error")
    )
    return O.inventory(files)


_INVENTORY = """files AS (SELECT source || ':' || doc_id % 400 AS key, '/f/' || lpad(CAST(doc_id AS VARCHAR), 9,
    '0') AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS digest,
    CASE WHEN doc_id % 50 = 7 THEN 'broken' END AS error FROM documents),
    inv AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY path) > 1 THEN first_value(path) OVER
    (PARTITION BY key ORDER BY path) END AS duplicate_of FROM files)"""


@register(
    "backfill_inventory",
    f"""WITH {_INVENTORY} SELECT count(*) AS files, count(*) FILTER (duplicate_of IS NULL) AS selected,
        count(*) FILTER (duplicate_of IS NOT NULL) AS duplicates,
        CAST(sum(bytes) FILTER (duplicate_of IS NULL) AS BIGINT) AS bytes,
        max(bytes) FILTER (duplicate_of IS NULL) AS largest, count(*) FILTER (error IS NOT NULL) AS errors FROM inv"""
)
def backfill_inventory(spark, sf_dir):
    return O.inventory_summary(_inventory(spark, sf_dir))


@register("backfill_duplicates", f"WITH {_INVENTORY} SELECT key, path, duplicate_of FROM inv WHERE duplicate_of IS NOT NULL")
def backfill_duplicates(spark, sf_dir):
    return _inventory(spark, sf_dir).where("duplicate_of is not null").select("key", "path", "duplicate_of")


@register(
    "backfill_selection",
    f"""WITH {_INVENTORY} SELECT key, path FROM inv
        WHERE duplicate_of IS NULL AND error IS NULL AND key >= 'src1' AND key <= 'src5' ORDER BY key LIMIT 100"""
)
def backfill_selection(spark, sf_dir):
    return O.selected(_inventory(spark, sf_dir), "src1", "src5", 100).select("key", "path")


@register(
    "backfill_capacity",
    f"""WITH {_INVENTORY} SELECT max(bytes) AS largest, CAST(sum(bytes) AS BIGINT) AS total,
        CASE WHEN max(bytes) > 67108864 THEN 'session_too_large' WHEN sum(bytes) > 1000000 THEN 'total_too_large' ELSE
        'fits' END AS verdict FROM inv WHERE duplicate_of IS NULL AND error IS NULL"""
)
def backfill_capacity(spark, sf_dir):
    return O.capacity(O.selected(_inventory(spark, sf_dir)), 64 << 20, 1_000_000)


@register("backfill_resume", f"""WITH {_INVENTORY}, sel AS (SELECT *, CAST(split_part(key, ':', 2) AS BIGINT) AS k
    FROM inv WHERE duplicate_of IS NULL AND error IS NULL),
    c AS (SELECT key, bytes + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS bytes, digest,
    CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'completed' END AS state FROM sel WHERE k % 3 <> 0),
    d AS (SELECT key, digest AS stored_digest FROM sel WHERE k % 4 <> 0)
    SELECT s.key, CASE WHEN c.state IS NULL OR c.state <> 'completed' THEN 'pending' WHEN s.bytes = c.bytes AND s.digest
    = c.digest AND d.stored_digest IS NOT DISTINCT FROM c.digest THEN 'skip' ELSE 'quarantine' END AS plan FROM sel s
    LEFT JOIN c ON c.key = s.key LEFT JOIN d ON d.key = s.key""")
def backfill_resume(spark, sf_dir):
    files = O.selected(_inventory(spark, sf_dir)).withColumn("k", F.split_part("key", F.lit(":"), F.lit(2)).cast("bigint"))
    done = files.where("k % 3 <> 0").select(
        "key",
        (F.col("bytes") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("bytes"),
        "digest",
        F.when(F.col("k") % 7 == 0, "failed").otherwise("completed").alias("state")
    )
    return O.resume_plan(files, done, files.where("k % 4 <> 0").select("key", F.col("digest").alias("stored_digest")), ["bytes", "digest"])


@register(
    "backfill_checkpoint",
    """SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS run,
        count(*) AS versions FROM orders GROUP BY o_custkey"""
)
def backfill_checkpoint(spark, sf_dir):
    return O.checkpoint_view(
        _orders(spark, sf_dir).select(F.col("custkey").alias("key"), F.col("title").alias("state"), F.col("id").alias("run"))
    )


@register(
    "backfill_verify",
    f"""WITH {_INVENTORY} SELECT DISTINCT 'src' || (c_custkey % 25) || ':' || c_custkey AS key FROM customer
        WHERE 'src' || (c_custkey % 25) || ':' || c_custkey NOT IN (SELECT key FROM inv WHERE key IS NOT NULL)"""
)
def backfill_verify(spark, sf_dir):
    c = F.col("c_custkey")
    known = V.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src"), (c % 25).cast("string"), F.lit(":"), c.cast("string")).alias("key")
    ).distinct()
    return O.not_found(known, _inventory(spark, sf_dir))


@register("sync_plan", with_views("""SELECT s.id, s.message_count AS stored, coalesce(m.n, 0) AS loaded,
    CASE WHEN coalesce(m.n, 0) = 0 THEN 'refuse_empty' WHEN m.n < s.message_count THEN 'refuse_short' ELSE 'push' END AS
    verdict
    FROM (SELECT * FROM v_transcripts ORDER BY started_at DESC NULLS LAST, id LIMIT 500) s LEFT
    JOIN (SELECT session_id, count(*) AS n FROM v_messages
    WHERE CAST(session_id AS BIGINT) % 10 <> 3 AND (CAST(session_id AS BIGINT) % 10 <> 4 OR sequence_num > 0)
    GROUP BY session_id) m ON m.session_id = s.id""", "v_transcripts", "v_messages"))
def sync_plan(spark, sf_dir):
    k = F.col("session_id").cast("bigint") % 10
    return O.sync_plan(V.transcripts(spark, sf_dir), V.messages(spark, sf_dir).where((k != 3) & ((k != 4) | (F.col("sequence_num") > 0))))


_READ = """b AS (SELECT event_type AS source, 'p' || event_id AS path, event_id AS k, event_id % 97 AS mtime,
    event_id % 13 AS size FROM events),
    told AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'bad record' WHEN k % 17 = 0 THEN 'file vanished after parsing' WHEN k
    % 23 = 0 THEN 'incomplete trailing record' WHEN k % 19 = 0 THEN 'file changed during parsing' END AS message
    FROM b),
    state AS (SELECT source, path, CASE WHEN k % 29 <> 0 AND k % 17 <> 0 AND k % 19 = 0 THEN mtime + 1 ELSE mtime END AS
    mtime, size, CASE WHEN k % 29 = 0 THEN 'error' WHEN message IS NOT NULL THEN 'pending' ELSE 'ok' END AS status,
    message FROM told)"""


def _read(spark, sf_dir):
    k = F.col("event_id")
    e = V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.concat(F.lit("p"), k.cast("string")).alias("path"),
        k.alias("k"),
        (k % 97).alias("mtime"),
        (k % 13).alias("size")
    )
    after = e.where("k % 17 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("k") % 19 == 0, 1).otherwise(0))
    return O.deferred(
        e,
        after,
        e.select("source", "path", (F.col("k") % 23 == 0).alias("incomplete"), F.when(F.col("k") % 29 == 0, "bad record").alias("error"))
    )


@register("file_deferral", f"WITH {_READ} SELECT source, path, mtime, size, status, message FROM state")
def file_deferral(spark, sf_dir):
    return _read(spark, sf_dir)


@register(
    "file_state_upsert",
    f"""WITH {_READ} SELECT source, path, mtime, size, status, message, 2 AS run FROM state WHERE status <> 'ok'
        UNION ALL SELECT source, path, mtime, size, 'pending', 'new', 1 FROM b WHERE path NOT IN (SELECT path FROM state
        WHERE status <> 'ok')"""
)
def file_state_upsert(spark, sf_dir):
    old = V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"),
        (F.col("event_id") % 97).alias("mtime"),
        (F.col("event_id") % 13).alias("size"),
        F.lit("pending").alias("status"),
        F.lit("new").alias("message"),
        F.lit(1).alias("run")
    )
    return O.state_upserted(old, _read(spark, sf_dir).where("status <> 'ok'").withColumn("run", F.lit(2)))


@register(
    "backfill_staleness",
    f"""WITH {_INVENTORY} SELECT key, (right(path, 1) = '3' OR right(path, 1) = '4') AS stale FROM inv
        WHERE duplicate_of IS NULL AND error IS NULL"""
)
def backfill_staleness(spark, sf_dir):
    """Entries whose content changed (paths that end in 3) or that vanished (4) since the inventory."""
    chosen = O.selected(_inventory(spark, sf_dir))
    fresh = chosen.where(~F.col("path").endswith("4")).withColumn(
        "digest",
        F.when(F.col("path").endswith("3"), "other").otherwise(F.col("digest"))
    )
    return O.stale(fresh, chosen, ["path", "bytes", "digest"])


@register(
    "backfill_checkpoint_write",
    """SELECT o_custkey AS key, CASE WHEN o_custkey % 2 = 0 THEN 'completed' WHEN arg_max(o_orderkey % 3,
        o_orderkey) = 0 THEN 'skipped' ELSE 'completed' END AS state,
        CASE WHEN o_custkey % 2 = 0 THEN max(max(o_orderkey)) OVER () + 1 ELSE max(o_orderkey) END AS run FROM orders
        GROUP BY o_custkey"""
)
def backfill_checkpoint_write(spark, sf_dir):
    """A checkpoint with rows of an old version, and one more run over every second key."""
    key = F.col("o_orderkey")
    o = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"),
        F.lit("completed").alias("state"),
        key.alias("run"),
        F.when(key % 3 == 0, 1).otherwise(2).alias("version"),
        key.cast("string").alias("digest")
    )
    done = o.select("key").distinct().where("key % 2 = 0").select("key", F.lit("completed").alias("state"), F.lit("new").alias("digest"))
    return O.checkpoint_view(O.readable(O.checkpoint_written(o, done, 2), 2)).select("key", "state", "run")


@register(
    "pane_listing",
    """SELECT event_id, machine, pos FROM (SELECT event_id, 'm' || user_id % 3 AS machine,
        row_number() OVER (PARTITION BY user_id % 3 ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN
        'purchase' THEN 2 ELSE 3 END, 'box-' || user_id % 9, user_id % 4, event_id) AS pos FROM events)"""
)
def pane_listing(spark, sf_dir):
    u = F.col("user_id")
    status = F.when(
        F.col("event_type") == "click",
        "needs_attention"
    ).when(F.col("event_type") == "view", "active").when(F.col("event_type") == "purchase", "idle").otherwise("dead")
    told = V.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("m"), (u % 3).cast("string")).alias("machine"),
        status.alias("status"),
        F.concat(F.lit("box-"), (u % 9).cast("string")).alias("session"),
        (u % 4).alias("window_index"),
        F.col("event_id").alias("pane_index")
    )
    return P.listing(told).select("event_id", "machine", "pos")
