"""Queries: recall, evidence, vectors, redaction."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import handoff as H
from ..operators import recall as R
from ..operators import search as S
from ..operators import vector as X
from ..operators.materialize import materialized
from . import views as V
from .registry import register
from .search import _SESSION_DOCS, _SESSION_QUERIES, _TOOL_DOCS, _session_queries, bm25_sql, snippet_sql
from .views import COSINE, NEAREST, with_views

_STOPS = "stops AS (SELECT string_split('" + " ".join(T.STOPWORDS) + "', ' ') AS stop)"
_TERMS = """list_filter(list_filter(regexp_extract_all(replace(replace(lower(query), '’', ''''), 'let''s', 'lets'), '[a-z0-9_./:@%+=-]+'), lambda t: regexp_matches(t, '[./:@=-]') OR (NOT list_contains(stop, t) AND length(t) >= 3)), lambda t: true)"""


def _terms_cte(queries: str) -> str:
    return f"""{_STOPS}, raw_terms AS (SELECT query_id, query, {_TERMS} AS raw FROM {queries}, stops),
        terms AS (SELECT query_id, query, list_filter(raw, lambda t, i: list_position(raw, t) = i) AS terms
        FROM raw_terms)"""


_VARIANTS = """items AS (SELECT query_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS compact, terms[1:8] AS terms
    FROM terms),
  many AS (SELECT query_id, 1 AS n, compact AS text, 'original' AS label,
    CASE WHEN len(terms) > 0 THEN 0.8 ELSE 1.0 END AS weight FROM items WHERE compact <> '' AND len(terms) > 0
    UNION ALL SELECT query_id, 2, array_to_string(terms, ' '), 'terms', 1.15 FROM items
    WHERE len(terms) > 0 AND lower(array_to_string(terms, ' ')) <> lower(compact)
    UNION ALL SELECT query_id, 2 + i, terms[i], 'term:' || terms[i], 0.28
    FROM items, unnest(range(1, len(terms) + 1)) AS r(i)),
  variants AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY n) AS f
    FROM many) WHERE f = 1)"""


@register(
    "query_variants",
    with_views(
        "SELECT query_id, text, label, CAST(weight AS DOUBLE) AS weight FROM variants",
        "v_queries",
        ctes=f"{_terms_cte('v_queries')}, {_VARIANTS}"
    )
)
def query_variants(spark, sf_dir):
    return R.query_variants(V.queries(spark, sf_dir)).select("query_id", "text", "label", "weight")


_META = """meta AS (SELECT query_id, session_id, snippet, pos
    FROM (SELECT q.query_id, s.id AS session_id, concat_ws('; ', 'source ' || source, 'project ' || project_name,
    'path ' || project_path, 'model ' || model, CASE WHEN title <> '' THEN 'title ' || title END) AS snippet,
  row_number() OVER (PARTITION BY q.query_id ORDER BY started_at DESC NULLS LAST, s.id) AS pos FROM v_transcripts s
    JOIN (SELECT query_id, needles[1:8] AS needles
    FROM (SELECT query_id, list_filter(list_filter(list_append(terms, lower(trim(query))), lambda t,
    i: list_position(list_append(terms, lower(trim(query))), t) = i), lambda t: length(t) >= 2) AS needles
    FROM terms)) q
  ON len(list_filter(needles, lambda n: contains(lower(coalesce(source, '')), n) OR contains(lower(coalesce(title, '')),
    n) OR contains(lower(coalesce(project_name, '')), n) OR contains(lower(coalesce(project_path, '')),
    n) OR contains(lower(coalesce(model, '')), n) OR contains(lower(coalesce(model_provider, '')),
    n) OR contains(lower(coalesce(git_branch, '')), n) OR contains(lower(coalesce(git_sha, '')),
    n) OR contains(lower(coalesce(git_origin_url, '')), n))) > 0) WHERE pos <= 20)"""


@register(
    "metadata_hits",
    with_views(
        "SELECT query_id, session_id, snippet, pos FROM meta",
        "v_transcripts",
        ctes=f"{_SESSION_QUERIES}, {_terms_cte('s_queries')}, {_META}"
    )
)
def metadata_hits(spark, sf_dir):
    return R.metadata_hits(V.transcripts(spark, sf_dir), _session_queries(spark, sf_dir))


def _best(hits: str, keys: str, weight: float, kind: str) -> str:
    return f"""SELECT query_id, session_id, '{kind}' AS kind, {weight} * weight / pos AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY variant, rank, started_at DESC, doc) AS pos
        FROM (SELECT *, row_number() OVER (PARTITION BY qk, {keys} ORDER BY variant, rank, started_at DESC, doc) AS n
        FROM
    (SELECT h.query_id AS qk, v.query_id, v.weight, h.variant, h.doc, h.rank, {hits}) ) WHERE n = 1) WHERE pos <= 20"""


_SIGNALS = f"""{_SESSION_QUERIES}, {_terms_cte('s_queries')}, {_VARIANTS},
    asked AS (SELECT query_id * 100 + n AS query_id, text AS query FROM variants),
    keyed AS (SELECT query_id * 100 + n AS qk, query_id, weight FROM variants),
  m_docs AS (SELECT id AS doc, content AS text
    FROM v_messages), {_SESSION_DOCS}, {_TOOL_DOCS}, {bm25_sql('m_docs', 'asked', 'm_')},
    {bm25_sql('s_docs', 'asked', 's_')}, {bm25_sql('t_docs', 'asked', 't_')},
    {snippet_sql('t_', 't_docs', 'tool_name', 'tool_input', 'tool_output')}, {_META},
  found AS ({_best("m.session_id, s.started_at FROM m_ranked h JOIN keyed v ON v.qk = h.query_id JOIN v_messages m ON m.id = h.doc JOIN v_transcripts s ON s.id = m.session_id", "session_id", 5.0, "message")}
    UNION ALL {_best("h.doc AS session_id, s.started_at FROM s_ranked h JOIN keyed v ON v.qk = h.query_id JOIN v_transcripts s ON s.id = h.doc", "session_id", 3.25, "session")}
    UNION ALL {_best("d.session_id, d.tool_name, b.snippet, s.started_at FROM t_ranked h JOIN t_best b USING (query_id, variant, doc) JOIN keyed v ON v.qk = h.query_id JOIN t_docs d ON d.doc = h.doc JOIN v_transcripts s ON s.id = d.session_id", "session_id, tool_name, snippet", 4.5, "tool_call")}
    UNION ALL SELECT query_id, session_id, 'graph', 2.25 / pos FROM meta),
  vague AS (SELECT query_id FROM terms WHERE (len(terms) = 0 OR regexp_matches(query,
    '(?i)\\b(resume|continue|pick up|where did we leave|building this|this thing)\\b')) AND query_id NOT IN (SELECT
    query_id FROM found)),
  latest AS (SELECT id AS session_id, row_number() OVER (ORDER BY started_at DESC NULLS LAST, id) AS pos
    FROM v_transcripts QUALIFY pos <= 20),
  signals AS (SELECT query_id, session_id, kind, sum(score) AS score FROM (SELECT * FROM found
    UNION ALL SELECT query_id, session_id, 'recent', 0.75 / pos FROM vague, latest) GROUP BY ALL)"""


#: As _SIGNALS, with the semantic signal: vectors are those of first messages and of the questions' numbers.
_SEMANTIC_SIGNALS = _SIGNALS.replace("UNION ALL SELECT query_id, session_id, 'graph', 2.25 / pos FROM meta)", """UNION ALL
    SELECT query_id, session_id, 'graph', 2.25 / pos FROM meta
    UNION ALL SELECT query_id, session_id, 'semantic', 3.75 * greatest(0.05, cosine + 1e-7) FROM close)""").replace("  found AS (", f"""  pairs
        AS (SELECT a.query_id, m.id AS message_id, m.session_id, {COSINE} AS cosine FROM s_queries a
        JOIN embeddings q ON q.vec_id = a.query_id, embeddings e JOIN v_messages m ON m.id = e.vec_id || ':0'),
  close AS (SELECT query_id, session_id, cosine
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, session_id) AS pos
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY cosine DESC, message_id) AS n
        FROM pairs) WHERE n = 1) WHERE pos <= 40),
  found AS (""", 1)


def _semantic(spark, sf_dir, asked):
    e, messages = V.table(spark, sf_dir, "embeddings"), V.messages(spark, sf_dir)
    vectors = e.select(
        F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("id"),
        "embedding"
    ).join(messages.select("id", "session_id", "content"), "id")
    vectors = vectors.select(
        F.col("id").alias("message_id"),
        "session_id",
        F.lit(0).alias("chunk_index"),
        F.left("content", F.lit(2000)).alias("chunk_text"),
        X.packed("embedding").alias("embedding")
    )
    questions = asked.select("query_id").join(
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")),
        "query_id"
    )
    return R.semantic_hits(vectors, questions, limit=40)


def _told_and_asked(spark, sf_dir):
    """The transcripts and the questions about them, which many steps read."""
    transcripts = materialized(V.transcripts(spark, sf_dir))
    return transcripts, materialized(_session_queries(spark, sf_dir, transcripts))


@register("semantic_hits", with_views("""SELECT query_id, session_id, message_id, cosine, pos,
    left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 200) AS snippet
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, session_id) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY cosine DESC, message_id) AS n
    FROM pairs) WHERE n = 1) WHERE pos <= 40""", "v_transcripts", "v_messages",
    ctes=f"""{_SESSION_QUERIES}, pairs AS (SELECT a.query_id, m.id AS message_id, m.session_id, left(m.content,
        2000) AS content, {COSINE} AS cosine FROM s_queries a JOIN embeddings q ON q.vec_id = a.query_id, embeddings e
        JOIN v_messages m ON m.id = e.vec_id || ':0')"""))
def semantic_hits(spark, sf_dir):
    """The nearest transcripts of each question, over packed vectors, with the text of the chunk."""
    return _semantic(spark, sf_dir, _session_queries(spark, sf_dir))


@register("recall_semantic", with_views("""SELECT query_id, session_id, score, rank, signals
    FROM (SELECT t.query_id, t.session_id, t.score, t.signals,
    row_number() OVER (PARTITION BY t.query_id ORDER BY t.score DESC, s.started_at DESC NULLS LAST,
    t.session_id) AS rank FROM
    (SELECT query_id, session_id, round(CAST(sum(score) AS DOUBLE), 4) AS score, string_agg(kind,
    ',' ORDER BY -round(score, 6), kind) AS signals FROM signals GROUP BY query_id, session_id) t
    JOIN v_transcripts s ON s.id = t.session_id) WHERE rank <= 10""", "v_transcripts", "v_messages", "v_tool_calls", ctes=_SEMANTIC_SIGNALS))
def recall_semantic(spark, sf_dir):
    """Recall fed with all of its signals, the semantic one among them."""
    transcripts, asked = _told_and_asked(spark, sf_dir)
    # cosines have six decimals; beyond them no score lies halfway between two of four
    near = _semantic(spark, sf_dir, asked).withColumn("cosine", F.col("cosine") + 1e-7)
    signals = R.recall_signals(V.messages(spark, sf_dir), transcripts, V.tool_calls(spark, sf_dir), asked, semantic=near)
    return R.recall(signals, transcripts)


@register("recall_results")
def recall_results(spark, sf_dir):
    """The assembled answer: rank, reason, evidence, matching calls, paths, resume command, semantic status."""
    transcripts, asked = _told_and_asked(spark, sf_dir)
    return R.recall_results(
        V.messages(spark, sf_dir),
        transcripts,
        V.tool_calls(spark, sf_dir),
        asked,
        semantic=_semantic(spark, sf_dir, asked),
        status="used",
        resumable={"project": "agent", "logs": "agent"}
    )


def _signals(spark, sf_dir):
    return R.recall_signals(
        V.messages(spark, sf_dir),
        V.transcripts(spark, sf_dir),
        V.tool_calls(spark, sf_dir),
        _session_queries(spark, sf_dir)
    )


_ALL = ("v_transcripts", "v_messages", "v_tool_calls")


@register(
    "recall_signals",
    with_views(
        """SELECT query_id, kind, count(*) AS transcripts, round(CAST(sum(score) AS DOUBLE), 6) AS score FROM signals
            GROUP BY query_id, kind""",
        *_ALL,
        ctes=_SIGNALS
    )
)
def recall_signals(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("query_id", "kind").agg(
        F.count("*").alias("transcripts"),
        F.round(F.sum("score"), 6).alias("score")
    )


@register("recall", with_views("""SELECT query_id, session_id, score, rank, signals
    FROM (SELECT t.query_id, t.session_id, t.score, t.signals,
    row_number() OVER (PARTITION BY t.query_id ORDER BY t.score DESC, s.started_at DESC NULLS LAST,
    t.session_id) AS rank FROM
    (SELECT query_id, session_id, round(CAST(sum(score) AS DOUBLE), 4) AS score, string_agg(kind,
    ',' ORDER BY -round(score, 6), kind) AS signals FROM signals GROUP BY query_id, session_id) t
    JOIN v_transcripts s ON s.id = t.session_id) WHERE rank <= 10""", *_ALL, ctes=_SIGNALS))
def recall(spark, sf_dir):
    return R.recall(_signals(spark, sf_dir), V.transcripts(spark, sf_dir))


def _tool_wanted(spark, sf_dir):
    return V.transcripts(spark, sf_dir).select(
        (F.col("id").cast("bigint") % 5).alias("query_id"),
        F.col("id").alias("session_id"),
        F.concat(F.lit("click "), (F.col("id").cast("bigint") % 100).cast("string")).alias("query")
    )


@register("matching_tools", with_views("""SELECT query_id, session_id, id, pos, input_preview
    FROM (SELECT query_id, w.session_id, c.id, tool_input AS input_preview, row_number() OVER (PARTITION BY query_id,
    w.session_id ORDER BY timestamp, length(c.id), c.id) AS pos FROM v_tool_calls c JOIN
    (SELECT CAST(id AS BIGINT) % 5 AS query_id, id AS session_id, 'click ' || (CAST(id AS BIGINT) % 100) AS query
    FROM v_transcripts) w ON w.session_id = c.session_id
    WHERE contains(lower(concat_ws(chr(10), tool_name, tool_input, tool_output)),
    query) OR contains(lower(concat_ws(chr(10), tool_name, tool_input, tool_output)), 'click')) WHERE pos <= 8""", "v_transcripts", "v_tool_calls"))
def matching_tools(spark, sf_dir):
    return R.matching_tools(V.tool_calls(spark, sf_dir), _tool_wanted(spark, sf_dir))


@register("recall_evidence", with_views("""SELECT session_id, kind, snippet, score, pos
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE kind WHEN 'message' THEN 0 WHEN 'tool_call'
    THEN 1 ELSE 3 END, score DESC, snippet) AS pos FROM
    (SELECT session_id, kind, snippet, max(score) AS score
    FROM (SELECT session_id, 'message' AS kind, left(content, 40) AS snippet, CAST(sequence_num AS DOUBLE) AS score
    FROM v_messages UNION ALL SELECT session_id, 'tool_call', tool_name, duration FROM v_tool_calls
    UNION ALL SELECT id, 'session', title, 1.0 FROM v_transcripts) WHERE trim(snippet) <> '' GROUP BY ALL))
    WHERE pos <= 8""", *_ALL))
def recall_evidence(spark, sf_dir):
    kinds = [
        V.messages(spark, sf_dir).select(
            "session_id",
            F.lit("message").alias("kind"),
            F.left("content", F.lit(40)).alias("snippet"),
            F.col("sequence_num").cast("double").alias("score")
        )
    ]
    kinds.append(
        V.tool_calls(spark, sf_dir).select(
            "session_id",
            F.lit("tool_call").alias("kind"),
            F.col("tool_name").alias("snippet"),
            F.col("duration").alias("score")
        )
    )
    kinds.append(
        V.transcripts(spark, sf_dir).select(
            F.col("id").alias("session_id"),
            F.lit("session").alias("kind"),
            F.col("title").alias("snippet"),
            F.lit(1.0).alias("score")
        )
    )
    items = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("query_id", F.lit(1)).withColumn("signal", F.lit("all"))
    return R.evidence(items).select("session_id", "kind", "snippet", "score", "pos")


@register("recall_context", with_views(f"""SELECT session_id, id, hit, pos FROM (SELECT *,
    row_number() OVER (PARTITION BY session_id ORDER BY hit DESC, sequence_num, id) AS pos,
    max(CAST(hit AS INTEGER)) OVER (PARTITION BY session_id) AS any_hit FROM
    (SELECT m.*, len(list_intersect(list_filter(string_split_regex(strip_accents(lower(content)),
    '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), list_filter(string_split_regex(array_to_string(t.terms[1:8], ' '),
    '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) > 0 AS hit FROM v_messages m
    JOIN terms t ON CAST(t.query_id AS VARCHAR) = m.session_id))
    WHERE (hit AND pos <= 24) OR (any_hit = 0 AND pos <= 12)""",
    "v_transcripts", "v_messages", ctes=f"{_SESSION_QUERIES}, {_terms_cte('s_queries')}"))
def recall_context(spark, sf_dir):
    wanted = _session_queries(spark, sf_dir).withColumn("session_id", F.col("query_id").cast("string"))
    return R.session_context(V.messages(spark, sf_dir), wanted).select("session_id", "id", "hit", "pos")


@register("recall_tools", with_views(f"""SELECT session_id, id, held > 0 AS hit, pos
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY held DESC, coalesce(timestamp, '') DESC,
    id) AS pos FROM (SELECT *, count(*) FILTER (held > 0) OVER (PARTITION BY session_id) AS hits,
    row_number() OVER (PARTITION BY session_id ORDER BY coalesce(timestamp, '') DESC, id) AS nth FROM
    (SELECT c.session_id, c.id, c.timestamp,
    len(list_distinct(list_intersect(list_filter(string_split_regex(strip_accents(lower(concat_ws(' ', tool_name,
    tool_input, tool_output))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''),
    list_filter(string_split_regex(array_to_string(t.terms[1:8], ' '), '[^\\p{{L}}\\p{{N}}]+'),
    lambda x: x <> '')))) AS held FROM v_tool_calls c JOIN terms t ON CAST(t.query_id AS VARCHAR) = c.session_id))
    WHERE held > 0 OR (hits < 12 AND nth <= 12)) WHERE pos <= 64""",
    "v_tool_calls", ctes=f"""c_queries AS (SELECT c_custkey AS query_id, ['click 5', 'signup error', 'nothing here',
        '87 view'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS query FROM customer), {_terms_cte('c_queries')}"""))
def recall_tools(spark, sf_dir):
    k = F.col("c_custkey")
    query = F.get(F.array(*[F.lit(x) for x in ("click 5", "signup error", "nothing here", "87 view")]), (k % 4).cast("int"))
    wanted = V.table(spark, sf_dir, "customer").select(k.alias("query_id"), k.cast("string").alias("session_id"), query.alias("query"))
    return R.session_tools(V.tool_calls(spark, sf_dir), wanted).select("session_id", "id", "hit", "pos")


@register(
    "resume_metadata",
    with_views(
        """SELECT id, cmd IS NOT NULL AS available, cmd AS shell_command,
            CASE WHEN cmd IS NULL THEN 'no resume command for ' || source END AS reason
            FROM (SELECT id, source, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'run ' || id WHEN source = 'project' THEN
            'agent --resume ' || source_id WHEN source = 'logs' THEN 'agent --resume ''' || source_id || ' x''' END AS
            cmd FROM v_transcripts)""",
        "v_transcripts"
    )
)
def resume_metadata(spark, sf_dir):
    s = V.transcripts(spark, sf_dir)
    stored = F.when(
        F.col("id").cast("bigint") % 6 == 0,
        F.to_json(F.struct(F.concat(F.lit("run "), "id").alias("resume_command")))
    ).otherwise("{}")
    s = s.withColumn("metadata", stored).withColumn(
        "source_id",
        F.when(F.col("source") == "logs", F.concat("source_id", F.lit(" x"))).otherwise(F.col("source_id"))
    )
    return R.resume(s, {"project": "agent", "logs": "agent"})


@register("recall_reason", with_views("""SELECT id, CASE WHEN line <> '' THEN line ELSE 'matched recall signals' END AS
    reason FROM (SELECT id, concat_ws('; ', CASE WHEN tool_call_count > 0 THEN 'matched message, tool call' END,
    CASE WHEN tool_call_count > 0 THEN tool_call_count || ' matching tool call' || CASE WHEN tool_call_count = 1 THEN ''
    ELSE 's' END END, CASE WHEN title <> '' THEN 'top evidence: ' || substr(title, 1, 140) END) AS line
    FROM v_transcripts)""", "v_transcripts"))
def recall_reason(spark, sf_dir):
    kinds = F.when(F.col("tool_call_count") > 0, "message,tool_call").otherwise("")
    return V.transcripts(spark, sf_dir).select(
        "id",
        R.reason(kinds, F.col("tool_call_count"), F.lit(0), F.coalesce("title", F.lit(""))).alias("reason")
    )


@register("context_snippets", """SELECT conv_id, turn, CASE WHEN p > 0 THEN trim(regexp_replace(CASE WHEN greatest(p -
    70, 1) > 1 THEN '…' ELSE '' END || substr(text, greatest(p - 70, 1), least(p + 4 + 119,
    length(text)) - greatest(p - 70, 1) + 1) || CASE WHEN least(p + 4 + 119,
    length(text)) < length(text) THEN '…' ELSE '' END, '\\s+', ' ', 'g')) END AS snippet
    FROM (SELECT *, instr(lower(text), 'tion') AS p FROM conversations)""")
def context_snippets(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.snippet_around("text", F.lit("tion")).alias("snippet"))


_TRAIL = "'[),.;\\]}>\"''`]+$', ''"


@register(
    "extract_repos",
    f"""SELECT DISTINCT page_id, regexp_replace(r, {_TRAIL}) AS repo
        FROM (SELECT page_id, unnest(regexp_extract_all(html || ' https://github.com/x/' || page_id ||
        '.git), git@gitlab.com:a/b', '(?:https?://|git@)[^\\s\"''<>]+')) AS r FROM pages)
        WHERE regexp_matches(r, 'github\\.com|gitlab\\.com|bitbucket\\.org|\\.git\\b')"""
)
def extract_repos(spark, sf_dir):
    text = F.concat("html", F.lit(" https://github.com/x/"), F.col("page_id").cast("string"), F.lit(".git), git@gitlab.com:a/b"))
    return V.table(spark, sf_dir, "pages").select("page_id", F.explode(T.repositories(text)).alias("repo"))


@register(
    "extract_commits",
    """SELECT DISTINCT page_id, unnest(regexp_extract_all(html || ' fix deadbeef' || (page_id % 10),
        '(?i)\\b([0-9a-f]{7,40})\\b', 1)) AS sha FROM pages"""
)
def extract_commits(spark, sf_dir):
    text = F.concat("html", F.lit(" fix deadbeef"), (F.col("page_id") % 10).cast("string"))
    return V.table(spark, sf_dir, "pages").select("page_id", F.explode(T.commits(text)).alias("sha"))


@register("extract_branches", f"""SELECT DISTINCT doc_id, regexp_replace(b, {_TRAIL}) AS branch
    FROM (SELECT doc_id, unnest(list_concat(list_concat(regexp_extract_all(t,
    '\\bgit\\s+(?:checkout|switch)\\s+(?:-b\\s+)?([A-Za-z0-9._/-]+)', 1), regexp_extract_all(t,
    '(?i)\\bbranch[:=]\\s*([A-Za-z0-9._/-]+)', 1)), regexp_extract_all(t, '(?i)\\bon branch\\s+([A-Za-z0-9._/-]+)',
    1))) AS b
    FROM (SELECT doc_id, text || ' git checkout -b feat/' || doc_id || '. Branch: main, On branch dev' AS t
    FROM documents))""")
def extract_branches(spark, sf_dir):
    text = F.concat("text", F.lit(" git checkout -b feat/"), F.col("doc_id").cast("string"), F.lit(". Branch: main, On branch dev"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.branches(text)).alias("branch"))


@register("extract_paths")
def extract_paths(spark, sf_dir):
    text = F.concat("html", F.lit(" see /etc/app/"), F.col("page_id").cast("string"), F.lit(".conf:12 and src/lib/a.ts, README.md"))
    return V.table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.file_paths(text)).alias("pos", "path"))


@register("extract_commands", """SELECT event_id, trim(event_type || ' ' || value) AS command FROM events""")
def extract_commands(spark, sf_dir):
    said = F.concat_ws(
        "\n",
        F.lit(""),
        "props",
        F.concat(F.lit("  "), "event_type", F.lit(" "), F.col("value").cast("string")),
        F.lit("more")
    )
    return V.table(spark, sf_dir, "events").select("event_id", T.command_line(said).alias("command"))


@register("extract_commands_all", """SELECT event_id, trim(event_type || ' ' || value) AS command FROM events""")
def extract_commands_all(spark, sf_dir):
    """As ``extract_commands``, of every event."""
    said = F.concat_ws(
        "\n",
        F.lit(""),
        "props",
        F.concat(F.lit("  "), "event_type", F.lit(" "), F.col("value").cast("string")),
        F.lit("more")
    )
    return V.table(spark, sf_dir, "events").select("event_id", T.command_line(said).alias("command"))


@register(
    "json_key_values",
    """SELECT event_id, '/k' AS path, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events
        UNION ALL SELECT event_id, '/a', 'a', '{"b":"' || event_type || '"}' FROM events
        UNION ALL SELECT event_id, '/a/b', 'b', event_type FROM events"""
)
def json_key_values(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    nested = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(',"a":{"b":"'), "event_type", F.lit('"}}'))
    return R.json_values(e.select("event_id", nested.alias("json")), "json").select("event_id", "path", "key", "value")


_PLANTED = "text || ' key sk-abcdefghijklmnop' || doc_id || ' url https://u:pw@host/x password = hunter' || doc_id || '2; Bearer abcdefghijkl' || doc_id"


def _planted(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    text = F.concat(
        "text",
        F.lit(" key sk-abcdefghijklmnop"),
        n,
        F.lit(" url https://u:pw@host/x password = hunter"),
        n,
        F.lit("2; Bearer abcdefghijkl"),
        n
    )
    return V.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _sql_pattern(pattern: str) -> str:
    return pattern.replace(T.EDGE, r"\b").replace("'", "''")


def _sql_redacted(column: str) -> str:
    out = column
    for pattern, replacement in T.SECRETS:
        out = f"regexp_replace({out}, '{_sql_pattern(pattern)}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return out


@register(
    "redact_text",
    f"""SELECT doc_id, sha256({_sql_redacted('t')}) AS digest, right({_sql_redacted('t')}, 120) AS tail
        FROM (SELECT doc_id, {_PLANTED} AS t FROM documents)"""
)
def redact_text(spark, sf_dir):
    told = _planted(spark, sf_dir).select("doc_id", T.redacted("text").alias("r"))
    return told.select("doc_id", F.sha2("r", 256).alias("digest"), F.right("r", F.lit(120)).alias("tail"))


def _sql_counts(column: str) -> str:
    """How often each shape is replaced, in order, after those before it were."""
    out, parts = column, []
    for k, (pattern, replacement) in enumerate(T.SECRETS, 1):
        parts.append(f"CAST(sum(len(regexp_extract_all({out}, '{_sql_pattern(pattern)}'))) AS BIGINT) AS p{k:02d}")
        out = f"regexp_replace({out}, '{_sql_pattern(pattern)}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return ", ".join(parts)


@register("redaction_audit", f"SELECT count(*) AS docs, {_sql_counts('t')} FROM (SELECT {_PLANTED} AS t FROM documents)")
def redaction_audit(spark, sf_dir):
    told = _planted(spark, sf_dir).select(T.secret_counts("text").alias("counts"))
    return told.agg(F.count("*").alias("docs"), *[F.sum(F.get("counts", F.lit(k - 1))).alias(f"p{k:02d}") for k in range(1, len(T.SECRETS) + 1)])


def _sql_handed(column: str, length: int) -> str:
    return f"substr(trim(regexp_replace({_sql_redacted(column)}, '\\s+', ' ', 'g')), 1, {length})"


_SECRET_TURNS = """turns AS (SELECT session_id, sequence_num, role,
    CASE WHEN sequence_num % 3 = 1 THEN content || ' token=abcdef' || session_id || 'x' ELSE content END AS content
    FROM v_messages)"""


def _secret_turns(spark, sf_dir):
    """Messages of which a third hold a secret."""
    secret = F.concat("content", F.lit(" token=abcdef"), "session_id", F.lit("x"))
    return V.messages(spark, sf_dir).withColumn("content", F.when(F.col("sequence_num") % 3 == 1, secret).otherwise(F.col("content")))


@register(
    "recent_turns",
    with_views(
        f"""SELECT session_id, n, role, {_sql_handed('content', 200)} AS text
            FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_num DESC) AS n FROM turns)
            WHERE n <= 8""",
        "v_messages",
        ctes=_SECRET_TURNS
    )
)
def recent_turns(spark, sf_dir):
    return H.recent_turns(_secret_turns(spark, sf_dir))


@register(
    "context_summary",
    with_views(
        f"""SELECT session_id, coalesce({_sql_handed('last', 120)}, 'no user turn') AS summary
            FROM (SELECT session_id, arg_max(content, sequence_num) FILTER (role = 'user') AS last FROM turns
            GROUP BY session_id)""",
        "v_messages",
        ctes=_SECRET_TURNS
    )
)
def context_summary(spark, sf_dir):
    return H.context_summary(_secret_turns(spark, sf_dir))


@register("tool_commands", """SELECT session_id, pos, command FROM (SELECT session_id, command,
    row_number() OVER (PARTITION BY session_id ORDER BY o, command) AS pos
    FROM (SELECT session_id, command, min({'kind': kind, 'at': at_, 'id': id, 'path': path}) AS o FROM
    (SELECT CAST(user_id AS VARCHAR) AS session_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_,
    CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS kind,
    CASE WHEN event_type = 'click' THEN '/a/0/cmd' ELSE '' END AS path,
    CASE WHEN event_type = 'click' THEN 'make ' || event_id % 7 ELSE 'run ' || event_id % 5 END AS command FROM events
    WHERE event_type IN ('click', 'view'))
    GROUP BY session_id, command)) WHERE pos <= 16""")
def tool_commands(spark, sf_dir):
    """Commands under a key within arrays, and the inputs of shells, which begin with lines that are none."""
    k = F.col("id").cast("bigint")
    nested = F.concat(F.lit('{"a":[{"cmd":"\\n make '), (k % 7).cast("string"), F.lit('\\nmore"}],"other":"no"}'))
    shell = F.concat(F.lit("\n{\n  run "), (k % 5).cast("string"), F.lit("\nmore"))
    kind = F.col("tool_name")
    calls = V.tool_calls(spark, sf_dir).withColumn(
        "tool_input",
        F.when(kind == "click", nested).when(kind == "view", shell).otherwise('{"note":"cmd"}')
    )
    return H.commands(calls.withColumn("tool_name", F.when(kind == "view", "Bash").otherwise(kind)))


@register("auth_references", """SELECT c_nationkey AS owner, min(c_custkey) AS pos, lower(agent) AS agent, name,
    CASE WHEN name = '[REDACTED_AUTH_REF]' THEN 'secret-like auth reference was redacted; pass auth refs by name only'
    END AS warning FROM
    (SELECT c_nationkey, c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' ELSE c_mktsegment END
    AS agent, CASE c_custkey % 5 WHEN 0 THEN 'plain' WHEN 1 THEN '[REDACTED_AUTH_REF]' ELSE 'n' || (c_custkey % 3) ||
    ':x' END AS name FROM customer WHERE c_custkey % 5 < 4) GROUP BY c_nationkey, agent, name""")
def auth_references(spark, sf_dir):
    """References with and without an agent, secrets among them, and empty ones."""
    k = F.col("c_custkey")
    said = F.when(k % 5 == 0, " plain ").when(
        k % 5 == 1,
        F.concat(F.lit("key:sk-abcdefghijklmnopqrst"), k.cast("string"))
    ).when(k % 5 == 4, " ")
    said = said.otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(":n"), (k % 3).cast("string"), F.lit(":x")))
    given = V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner"), k.alias("pos"), said.alias("reference"))
    return H.auth_references(given, "owner")


@register(
    "record_hash",
    """SELECT conv_id, turn, sha256('{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"}') AS
        digest FROM conversations"""
)
def record_hash(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.sha2(F.to_json(F.struct(F.col("text").alias("content"), "role")), 256).alias("digest")
    )


@register("auth_refs", "SELECT DISTINCT lower(c_mktsegment) AS agent, 'n' || (c_custkey % 3) AS name FROM customer")
def auth_refs(spark, sf_dir):
    said = V.table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), "c_mktsegment", F.lit(":n"), (F.col("c_custkey") % 3).cast("string"), F.lit(" ")).alias("r")
    )
    plain = F.trim("r")
    return said.select(
        F.lower(F.split_part(plain, F.lit(":"), F.lit(1))).alias("agent"),
        F.split_part(plain, F.lit(":"), F.lit(2)).alias("name")
    ).dropDuplicates()


@register(
    "chunk_text",
    """SELECT doc_id AS id, i AS chunk_index, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS chunk_text
        FROM documents, unnest(range(0, CAST(floor((length(text) - 1) / 2000) AS BIGINT) + 1)) AS r(i)
        WHERE length(text) > 0"""
)
def chunk_text(spark, sf_dir):
    return X.chunks(
        V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    ).select("id", "chunk_index", "chunk_text")


@register(
    "pending_embeddings",
    with_views(
        """SELECT id, session_id FROM v_corpus WHERE trim(content) <> '' AND id NOT IN (SELECT CAST(vec_id AS VARCHAR)
            FROM embeddings) ORDER BY length(id), id LIMIT 200""",
        "v_corpus"
    )
)
def pending_embeddings(spark, sf_dir):
    known = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("message_id"))
    return X.pending(V.corpus(spark, sf_dir), known).select("id", "session_id")


def _nearest(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    session = F.concat(F.lit("s"), (F.col("vec_id") % 100).cast("string"))
    return X.nearest(
        e.select(F.col("vec_id").alias("message_id"), session.alias("session_id"), "embedding"),
        e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    )


@register("knn_cosine", f"WITH {NEAREST} SELECT * FROM knn")
def knn_cosine(spark, sf_dir):
    return _nearest(spark, sf_dir)


_WORDS = ["the", "la", "de", "und", "que", "et"]


def _counts(texts: list[str]) -> list[list[float]]:
    return [[float((text or "").lower().split().count(w)) for w in _WORDS] for text in texts]


@register(
    "semantic_search",
    with_views(
        """SELECT query_id, message_id, cosine, pos FROM (SELECT *,
            row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, session_id) AS pos
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY cosine DESC, message_id) AS n
            FROM (SELECT q.query_id, e.id AS message_id, e.session_id, CASE WHEN list_dot_product(e.v,
            e.v) * list_dot_product(q.v, q.v) = 0 THEN 0.0 ELSE round(list_dot_product(e.v,
            q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) END AS cosine
            FROM vecs e, qvecs q)) WHERE n = 1) WHERE pos <= 10""",
        "v_corpus",
        ctes="vecs AS (SELECT id, session_id, list_transform(['" + "','".join(_WORDS) + "'], lambda w: CAST(len(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x = w)) AS DOUBLE)) AS v FROM v_corpus), qvecs AS (SELECT r_regionkey AS query_id, list_transform(['" + "','".join(_WORDS) + "'], lambda w: CAST(len(list_filter(string_split(['the', 'la de', 'und', 'que la', 'et de la'][CAST(r_regionkey + 1 AS INTEGER)], ' '), lambda x: x = w)) AS DOUBLE)) AS v FROM region)"
    )
)
def semantic_search(spark, sf_dir):
    asked = F.get(F.array(*[F.lit(x) for x in ("the", "la de", "und", "que la", "et de la")]), F.col("r_regionkey").cast("int"))
    questions = X.embedded(V.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), asked.alias("q")), "q", _counts)
    vectors = X.embedded(V.corpus(spark, sf_dir), "content", _counts).select(F.col("id").alias("message_id"), "session_id", "embedding")
    return X.nearest(
        vectors,
        questions.select("query_id", F.col("embedding").alias("query_vector"))
    ).select("query_id", "message_id", "cosine", "pos")


_BAD = "coalesce(regexp_matches(trim(regexp_replace(regexp_replace({c}, '[\\[\\]]', '', 'g'), '\\s+', ' ', 'g')), '(?i)#?\\s*[a-z]+\\.md instructions for\\b|(?i)^\\s*<(?:goal_context|environment_context)\\b'), false)"
_LIST = """(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant, rank, started_at DESC, doc) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {keys} ORDER BY variant, rank, started_at DESC, doc) AS n
    FROM ({hits})) WHERE n = 1 QUALIFY pos <= 40)"""


def _list(hits: str, keys: str, number: int, weight: int) -> str:
    return f"""SELECT query_id, session_id, title, project_name, project_path, started_at, rank, pos, snippet,
        {number} AS list, {weight} AS weight FROM """ + _LIST.format(keys=keys, hits=hits)


_SAID = "s.title, s.project_name, s.project_path, s.started_at"
#: unified(query_id, session_id, list, score, rank, pos): the ranked list of at most 20 transcripts a question.
_UNIFIED = f"""{_SESSION_QUERIES}, m_docs AS (SELECT id AS doc, content AS text
    FROM v_messages), {_SESSION_DOCS}, {_TOOL_DOCS}, {bm25_sql('m_docs', 's_queries', 'm_')},
    {bm25_sql('s_docs', 's_queries', 's_')}, {bm25_sql('t_docs', 's_queries', 't_')},
  {snippet_sql('m_', 'm_docs', 'text')}, s_fields AS (SELECT id AS doc, title, project_name, project_path
    FROM v_transcripts), {snippet_sql('s_', 's_fields', 'title', 'project_name', 'project_path')},
    {snippet_sql('t_', 't_docs', 'tool_name', 'tool_input', 'tool_output')},
  lists AS ({_list(f"SELECT h.*, m.session_id, {_SAID}, b.snippet FROM m_ranked h JOIN m_best b USING (query_id, variant, doc) JOIN v_messages m ON m.id = h.doc JOIN v_transcripts s ON s.id = m.session_id", "session_id", 1, 10)}
    UNION ALL {_list(f"SELECT h.*, s.id AS session_id, {_SAID}, b.snippet FROM s_ranked h JOIN s_best b USING (query_id, variant, doc) JOIN v_transcripts s ON s.id = h.doc", "session_id", 2, 35)}
    UNION ALL {_list(f"SELECT h.*, d.session_id, d.tool_name, {_SAID}, b.snippet AS own, concat_ws(': ', d.tool_name, b.snippet) AS snippet FROM t_ranked h JOIN t_best b USING (query_id, variant, doc) JOIN t_docs d ON d.doc = h.doc JOIN v_transcripts s ON s.id = d.session_id", "session_id, tool_name, own", 3, 25)}),
  told AS (SELECT l.*, lower(trim(query)) AS plain, list_transform(regexp_extract_all(query, '[A-Za-z0-9_]+'),
    lambda x: lower(x)) AS parts, lower(coalesce(snippet, '')) AS txt, lower(coalesce(project_name, '')) AS nm,
    list_filter(string_split(lower(coalesce(project_path, '')), '/'), lambda x: x <> '') AS seg, lower(concat_ws(' ',
    CASE WHEN title <> '' AND NOT {_BAD.format(c="title")} THEN title END,
    CASE WHEN project_name <> '' THEN project_name END, CASE WHEN project_path <> '' THEN project_path END)) AS said
    FROM lists l JOIN s_queries USING (query_id)),
  scored AS (SELECT *, weight + coalesce(list_max(list_transform(list_filter(list_append(parts, plain),
    lambda t: t <> ''), lambda t: CASE WHEN nm = t THEN 140 WHEN seg[len(seg)] = t THEN 120 WHEN list_contains(seg,
    t) THEN 90 ELSE 0 END)), 0)
    + CASE WHEN plain <> '' AND contains(said, plain) THEN 100 ELSE 0 END + CASE WHEN plain <> '' AND contains(txt,
    plain) THEN 70 ELSE 0 END + CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda p: NOT contains(said,
    p))) = 0 THEN 60 ELSE 0 END
    + CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda p: NOT contains(txt,
    p))) = 0 THEN 35 ELSE 0 END - CASE WHEN {_BAD.format(c="title")} THEN 90 ELSE 0 END - CASE WHEN
    {_BAD.format(c="snippet")} THEN 90 ELSE 0 END AS score FROM told),
  unified AS (SELECT query_id, session_id, list, score, rank, pos
    FROM (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, started_at DESC,
    session_id) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY score DESC, list,
    pos) AS first FROM scored) WHERE first = 1) WHERE pos <= 20)"""


@register("search_unified", with_views("SELECT query_id, session_id, list, score, rank, pos FROM unified", *_ALL, ctes=_UNIFIED))
def search_unified(spark, sf_dir):
    return S.unified_search(
        V.messages(spark, sf_dir),
        V.transcripts(spark, sf_dir),
        V.tool_calls(spark, sf_dir),
        _session_queries(spark, sf_dir)
    )


@register("hybrid_rrf", with_views("""SELECT query_id, session_id, score, pos FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS pos FROM
    (SELECT query_id, session_id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score
    FROM (SELECT query_id, session_id, pos FROM unified UNION ALL SELECT query_id, session_id, pos FROM close)
    GROUP BY ALL)) WHERE pos <= 10""", *_ALL, ctes=f"""{_UNIFIED},
  pairs AS (SELECT a.query_id, m.id AS message_id, m.session_id, {COSINE} AS cosine FROM s_queries a
        JOIN embeddings q ON q.vec_id = a.query_id, embeddings e JOIN v_messages m ON m.id = e.vec_id || ':0'),
  close AS (SELECT query_id, session_id, pos
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, session_id) AS pos
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY cosine DESC, message_id) AS n
        FROM pairs) WHERE n = 1) WHERE pos <= 20)"""))
def hybrid_rrf(spark, sf_dir):
    """Full text and vectors together; the vector of a session's first message is that of its number, as is a question's."""
    e = V.table(spark, sf_dir, "embeddings")
    messages, asked = V.messages(spark, sf_dir), _session_queries(spark, sf_dir)
    vectors = e.select(
        F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("id"),
        "embedding"
    ).join(messages.select("id", "session_id"), "id").withColumnRenamed("id", "message_id")
    questions = asked.select("query_id").join(
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")),
        "query_id"
    )
    return S.hybrid_search(messages, V.transcripts(spark, sf_dir), V.tool_calls(spark, sf_dir), asked, vectors, questions, 10)
