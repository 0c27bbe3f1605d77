"""The model's tables as views over the given ones, in Spark and in SQL, so both engines read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the four kinds of source.
SOURCES = ["project", "rollout", "overlay", "logs"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    sid = F.col("conv_id").cast("string")
    return t.select(
        F.concat_ws(":", sid, F.col("turn").cast("string")).alias("id"),
        sid.alias("session_id"),
        "role",
        F.col("text").alias("content"),
        F.col("turn").alias("sequence_num")
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("tool_name"),
        F.col("props").alias("tool_input"),
        F.lit(None).cast("string").alias("tool_output"),
        F.col("value").alias("duration"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    first = conv.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("text"),
        F.count("*").alias("message_count")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"),
        F.col("source").alias("project_name"),
        F.col("lang").alias("model")
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_m"), F.col("n_name").alias("machine"))
    calls = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.count("*").alias("tool_call_count"))
    t = first.join(docs, "conv_id", "left").join(calls, "conv_id", "left").join(
        F.broadcast(nation),
        F.col("conv_id") % 30 == F.col("_m"),
        "left"
    )
    return t.select(
        F.col("conv_id").cast("string").alias("id"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("conv_id") % 4 + 1).cast("int")).alias("source"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("source_id"),
        F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 120).alias("title"),
        "project_name",
        F.concat(F.lit("/w/"), F.col("project_name")).alias("project_path"),
        "model",
        F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(conv_id as int), 0)"), "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        "machine",
        F.col("message_count").cast("bigint").alias("message_count"),
        F.coalesce("tool_call_count", F.lit(0)).cast("bigint").alias("tool_call_count"),
        F.concat(F.lit("maker"), (F.col("conv_id") % 3).cast("string")).alias("model_provider"),
        F.concat(F.lit("topic/"), "model").alias("git_branch"),
        F.left(F.md5(F.col("text").cast("binary")), F.lit(10)).alias("git_sha"),
        F.concat(F.lit("https://host.test/"), "project_name", F.lit(".git")).alias("git_origin_url"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a large table of messages; a source is a session."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("session_id"),
        F.col("text").alias("content")
    )


def corpus_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where("source is not null")
    return t.groupBy(F.col("source").alias("id")).agg(
        F.min("lang").alias("title"),
        F.max("source").alias("project_name"),
        F.lpad(F.max("doc_id").cast("string"), 12, "0").alias("started_at")
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the first 2 to 4 words of each benchmark passage."""
    t = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t.select(
        F.col("item_id").alias("query_id"),
        F.array_join(F.slice(words, F.lit(1), (2 + F.col("item_id") % 3).cast("int")), " ").alias("query")
    )


SQL = {
    "v_messages": """SELECT conv_id || ':' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id, role, text AS content,
        turn AS sequence_num FROM conversations""",
    "v_tool_calls": """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS session_id,
        event_type AS tool_name, props AS tool_input,
        CAST(NULL AS VARCHAR) AS tool_output, value AS duration,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM events""",
    "v_transcripts": """SELECT CAST(c.conv_id AS VARCHAR) AS id, CASE c.conv_id % 4 WHEN 0 THEN 'project' WHEN 1 THEN
        'rollout' WHEN 2 THEN 'overlay' ELSE 'logs' END AS source,
        's' || c.conv_id AS source_id, substr(trim(regexp_replace(c.text, '\\s+', ' ', 'g')), 1, 120) AS title,
        d.source AS project_name, '/w/' || d.source AS project_path,
        d.lang AS model, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c.conv_id),
        '%Y-%m-%d %H:%M:%S') AS started_at, n.n_name AS machine,
        CAST(c.message_count AS BIGINT) AS message_count, CAST(coalesce(e.n, 0) AS BIGINT) AS tool_call_count,
        'maker' || c.conv_id % 3 AS model_provider, 'topic/' || d.lang AS git_branch, left(md5(c.text), 10) AS git_sha,
        'https://host.test/' || d.source || '.git' AS git_origin_url
        FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS text, count(*) AS message_count
        FROM conversations GROUP BY conv_id) c
        LEFT JOIN documents d ON d.doc_id = c.conv_id LEFT JOIN (SELECT user_id, count(*) AS n FROM events
        GROUP BY user_id) e ON e.user_id = c.conv_id
        LEFT JOIN nation n ON n.n_nationkey = c.conv_id % 30""",
    "v_corpus": "SELECT CAST(doc_id AS VARCHAR) AS id, source AS session_id, text AS content FROM documents",
    "v_corpus_transcripts": """SELECT source AS id, min(lang) AS title, max(source) AS project_name,
        lpad(CAST(max(doc_id) AS VARCHAR), 12, '0') AS started_at FROM documents WHERE source IS NOT NULL
        GROUP BY source""",
    "v_queries": """SELECT item_id AS query_id, array_to_string(list_slice(list_filter(string_split_regex(text, '\\s+'),
        lambda w: w <> ''), 1, 2 + item_id % 3), ' ') AS query FROM benchmark""",
}


def with_views(select: str, *names: str, ctes: str = "") -> str:
    """``select`` in SQL over the named views and further ctes."""
    parts = [f"{name} AS ({SQL[name]})" for name in names] + ([ctes.strip().rstrip(",")] if ctes.strip() else [])
    return f"WITH {', '.join(parts)} {select}" if parts else select


#: In SQL, the cosine of e.embedding and q.embedding, and the cte knn of the nearest vectors of each fiftieth one.
COSINE = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6)"
NEAREST = f"""knn AS (SELECT query_id, message_id, session_id, cosine, pos
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, session_id) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY cosine DESC, message_id) AS n FROM
    (SELECT q.vec_id AS query_id, e.vec_id AS message_id, 's' || (e.vec_id % 100) AS session_id, {COSINE} AS cosine
    FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE n = 1) WHERE pos <= 10)"""
