"""Queries: statistics, graph, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from . import views as V
from .registry import register
from .views import with_views

_CALLS = ("v_tool_calls",)


@register(
    "stats_by_source",
    with_views(
        """SELECT source, count(*) AS transcripts, CAST(sum(message_count) AS BIGINT) AS messages,
            CAST(sum(tool_call_count) AS BIGINT) AS tool_calls FROM v_transcripts GROUP BY source""",
        "v_transcripts"
    )
)
def stats_by_source(spark, sf_dir):
    return S.by_source(V.transcripts(spark, sf_dir))


@register(
    "store_totals",
    with_views(
        """SELECT (SELECT count(*) FROM v_transcripts) AS transcripts, (SELECT count(*)
            FROM v_messages) AS messages, (SELECT count(*)
            FROM v_tool_calls) AS tool_calls, (SELECT count(DISTINCT source)
            FROM v_transcripts) AS sources, (SELECT count(DISTINCT project_path) FROM v_transcripts) AS projects""",
        "v_transcripts", "v_messages", "v_tool_calls",
    ),
)
def store_totals(spark, sf_dir):
    return S.store_totals(V.transcripts(spark, sf_dir), V.messages(spark, sf_dir), V.tool_calls(spark, sf_dir))


@register(
    "project_stats",
    with_views(
        """SELECT project_path, max(project_name) AS project_name, count(*) AS transcripts,
            max(started_at) AS last_started FROM v_transcripts WHERE project_path IS NOT NULL GROUP BY project_path""",
        "v_transcripts"
    )
)
def project_stats(spark, sf_dir):
    return S.project_stats(V.transcripts(spark, sf_dir))


@register(
    "top_projects",
    with_views(
        """SELECT project_name, project_path, count(*) AS transcripts FROM v_transcripts
            GROUP BY ALL ORDER BY transcripts DESC, project_path NULLS LAST LIMIT 30""",
        "v_transcripts"
    )
)
def top_projects(spark, sf_dir):
    return S.top_projects(V.transcripts(spark, sf_dir))


@register(
    "project_paths",
    with_views(
        """SELECT coalesce(project_path, '(none)') AS path, coalesce(project_name, project_path, '(none)') AS label,
            count(*) AS transcripts FROM v_transcripts GROUP BY ALL""",
        "v_transcripts"
    )
)
def project_paths(spark, sf_dir):
    return S.project_paths(V.transcripts(spark, sf_dir))


@register(
    "unknown_sources",
    with_views(
        "SELECT source, count(*) AS transcripts FROM v_transcripts WHERE source NOT IN ('project', 'rollout') GROUP BY source",
        "v_transcripts"
    )
)
def unknown_sources(spark, sf_dir):
    return S.unknown_sources(V.transcripts(spark, sf_dir), ["project", "rollout"])


@register(
    "machine_counts",
    with_views(
        "SELECT machine, count(*) AS transcripts FROM v_transcripts WHERE machine IS NOT NULL AND machine <> '' GROUP BY machine",
        "v_transcripts"
    )
)
def machine_counts(spark, sf_dir):
    return S.machine_counts(V.transcripts(spark, sf_dir))


def _machines(spark, sf_dir):
    nation, region = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    known = nation.where("n_nationkey % 5 <> 4").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return known.select(
        F.col("n_name").alias("name"),
        F.col("r_name").alias("region"),
        F.lit("2024-01-01 00:10:00").alias("first_seen_at"),
        F.lit("2024-01-01 03:00:00").alias("last_seen_at")
    )


_MACHINES = """machines AS (SELECT n_name AS name, r_name AS region, '2024-01-01 00:10:00' AS first_seen_at,
    '2024-01-01 03:00:00' AS last_seen_at FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE n_nationkey % 5 <> 4)"""


@register(
    "machine_rollup",
    with_views(
        """SELECT s.machine, m.region, s.transcripts, least(s.a, m.first_seen_at) AS first_seen, greatest(s.b,
            m.last_seen_at) AS last_seen FROM (SELECT machine, count(*) AS transcripts, min(started_at) AS a,
            max(started_at) AS b FROM v_transcripts WHERE machine IS NOT NULL GROUP BY machine) s LEFT
            JOIN machines m ON m.name = s.machine""",
        "v_transcripts", ctes=_MACHINES,
    ),
)
def machine_rollup(spark, sf_dir):
    return S.machine_rollup(V.transcripts(spark, sf_dir), _machines(spark, sf_dir))


_EDGES = """edges AS (SELECT DISTINCT session_id, type, name FROM (
    SELECT id AS session_id, 'project' AS type, project_name AS name FROM v_transcripts
    UNION ALL SELECT id, 'model', model FROM v_transcripts
    UNION ALL SELECT id, 'provider', source FROM v_transcripts UNION ALL SELECT id, 'machine', machine
    FROM v_transcripts
    UNION ALL SELECT session_id, 'tool', tool_name FROM v_tool_calls) WHERE name IS NOT NULL AND name <> '')"""


@register(
    "graph_entities",
    with_views("SELECT type, name, count(*) AS transcripts FROM edges GROUP BY type, name", "v_transcripts", "v_tool_calls", ctes=_EDGES)
)
def graph_entities(spark, sf_dir):
    return S.entities(V.transcripts(spark, sf_dir), V.tool_calls(spark, sf_dir))


@register(
    "graph_related",
    with_views(
        """SELECT type, name, session_id, started_at, pos
            FROM (SELECT e.*, s.started_at, row_number() OVER (PARTITION BY type, name ORDER BY s.started_at DESC,
            session_id) AS pos FROM edges e JOIN v_transcripts s ON s.id = e.session_id WHERE type IN ('tool', 'model'))
            WHERE pos <= 50""",
        "v_transcripts", "v_tool_calls", ctes=_EDGES,
    ),
)
def graph_related(spark, sf_dir):
    transcripts, calls = V.transcripts(spark, sf_dir), V.tool_calls(spark, sf_dir)
    wanted = S.edges(transcripts, calls).where("type in ('tool', 'model')").select("type", "name").distinct()
    return S.related_transcripts(transcripts, calls, wanted).select("type", "name", "session_id", "started_at", "pos")


@register(
    "graph_neighborhood",
    with_views("""SELECT s.id, s.project_name, s.model, s.source AS provider, s.machine, coalesce(t.tools, '') AS tools
        FROM v_transcripts s LEFT JOIN (SELECT session_id, string_agg(DISTINCT tool_name,
        ',' ORDER BY tool_name) AS tools FROM v_tool_calls GROUP BY session_id) t ON t.session_id = s.id""", "v_transcripts", "v_tool_calls"),
)
def graph_neighborhood(spark, sf_dir):
    return S.neighborhood(V.transcripts(spark, sf_dir), V.tool_calls(spark, sf_dir))


@register(
    "list_transcripts",
    with_views("SELECT id, source, title, started_at FROM v_transcripts ORDER BY started_at DESC, id LIMIT 20 OFFSET 10", "v_transcripts")
)
def list_transcripts(spark, sf_dir):
    return S.list_transcripts(V.transcripts(spark, sf_dir), limit=20, offset=10).select("id", "source", "title", "started_at")


@register(
    "recent",
    with_views(
        "SELECT id, source, started_at FROM v_transcripts WHERE source = 'rollout' ORDER BY started_at DESC, id LIMIT 10",
        "v_transcripts"
    )
)
def recent(spark, sf_dir):
    return S.list_transcripts(V.transcripts(spark, sf_dir), F.col("source") == "rollout", limit=10).select("id", "source", "started_at")


@register(
    "history_agent",
    with_views(
        """SELECT id, source, title FROM (SELECT * FROM v_transcripts ORDER BY started_at DESC, id LIMIT 200)
            WHERE started_at LIKE '2024-01-01%' AND contains(lower(concat_ws(' ', source, title, model)), 'en')""",
        "v_transcripts"
    )
)
def history_agent(spark, sf_dir):
    return S.history(V.transcripts(spark, sf_dir), "EN", "2024-01-01").select("id", "source", "title")


@register(
    "project_filter",
    with_views(
        """SELECT id, project_path FROM v_transcripts
            WHERE project_path = 'SRC1' OR project_name = 'SRC1' OR contains(lower(project_path),
            'src1') OR contains(lower(project_name), 'src1')""",
        "v_transcripts"
    )
)
def project_filter(spark, sf_dir):
    return V.transcripts(spark, sf_dir).where(S.in_project("SRC1")).select("id", "project_path")


@register(
    "latest_per_project",
    with_views(
        """SELECT project_path, id, started_at FROM (SELECT *,
            row_number() OVER (PARTITION BY project_path ORDER BY started_at DESC, id) AS n FROM v_transcripts
            WHERE project_path IS NOT NULL) WHERE n = 1""",
        "v_transcripts"
    )
)
def latest_per_project(spark, sf_dir):
    return S.latest_per_project(V.transcripts(spark, sf_dir)).select("project_path", "id", "started_at")


@register(
    "session_detail",
    with_views(
        """SELECT m.session_id, m.id, m.role, m.n, s.title, s.source
            FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_num, id) AS n
            FROM v_messages) m JOIN v_transcripts s ON s.id = m.session_id WHERE m.n <= 4""",
        "v_messages",
        "v_transcripts"
    )
)
def session_detail(spark, sf_dir):
    return S.session_detail(
        V.transcripts(spark, sf_dir),
        V.messages(spark, sf_dir),
        4
    ).select("session_id", "id", "role", "n", "title", "source")


_WANTED = """wanted AS (SELECT DISTINCT identifier, trim(identifier) AS want FROM (SELECT id AS identifier
    FROM v_transcripts WHERE CAST(id AS BIGINT) % 7 = 0
    UNION ALL SELECT source || ':' || source_id FROM v_transcripts WHERE CAST(id AS BIGINT) % 5 = 0
    UNION ALL SELECT source || ':' || left(source_id, 2) FROM v_transcripts WHERE CAST(id AS BIGINT) % 3 = 0
    UNION ALL SELECT source_id FROM v_transcripts WHERE CAST(id AS BIGINT) % 11 = 0 UNION ALL SELECT 's1'
    UNION ALL SELECT 'nothing' UNION ALL SELECT ' ')),
  hits AS (SELECT w.identifier, l.level, s.id FROM wanted w JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS level) l ON true
    JOIN v_transcripts s ON w.want <> '' AND CASE l.level
    WHEN 1 THEN s.id = w.want WHEN 2 THEN s.source || ':' || s.source_id = w.want WHEN 3 THEN starts_with(s.source ||
    ':' || s.source_id, w.want) AND starts_with(w.want, s.source || ':') AND length(w.want) > length(s.source) + 1
    WHEN 4 THEN s.source_id = w.want ELSE starts_with(s.source_id, w.want) OR starts_with(s.id, w.want) END),
  best AS (SELECT identifier, min(level) AS level FROM hits GROUP BY identifier),
  told AS (SELECT h.identifier, CAST(h.level AS INTEGER) AS level, count(*) AS matches,
    array_to_string(list_slice(list_sort(list(DISTINCT id)), 1, 6), ',') AS candidates FROM hits h
    JOIN best b ON b.identifier = h.identifier AND b.level = h.level GROUP BY h.identifier, h.level)"""


def wanted_identifiers(spark, sf_dir):
    s = V.transcripts(spark, sf_dir)
    n = F.col("id").cast("bigint")
    asked = [
        s.where(n % 7 == 0).select(F.col("id").alias("identifier")),
        s.where(n % 5 == 0).select(F.concat_ws(":", "source", "source_id")),
        s.where(n % 3 == 0).select(F.concat_ws(":", "source", F.left("source_id", F.lit(2)))),
        s.where(n % 11 == 0).select("source_id")
    ]
    wanted = asked[0]
    for more in [*asked[1:], spark.sql("SELECT explode(array('s1', 'nothing', ' '))")]:
        wanted = wanted.union(more)
    return wanted


@register(
    "resolve_identifier",
    with_views("""SELECT w.identifier, CASE WHEN w.want = '' THEN 'invalid' WHEN t.matches IS NULL THEN 'missing' WHEN
        t.matches > 1 THEN 'ambiguous' ELSE 'unique' END AS status, t.level, coalesce(t.matches, 0) AS matches,
        coalesce(t.candidates, '') AS candidates FROM wanted w LEFT JOIN told t ON t.identifier = w.identifier""", "v_transcripts", ctes=_WANTED),
)
def resolve_identifier(spark, sf_dir):
    return S.resolve_identifiers(V.transcripts(spark, sf_dir), wanted_identifiers(spark, sf_dir))
