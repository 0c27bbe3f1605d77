"""The queries of this subpackage that SQL can express on whole tables, in DuckDB's SQL."""

from __future__ import annotations

_WORD = "[^\\x20\\x09-\\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM w, unnest(range(1, len(w) - 1)) AS r(i)
    WHERE len(w) >= 3
    UNION ALL SELECT doc_id, 'few ' || array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * i >= 90 * (x.n + y.n - i)),
  ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM ways UNION SELECT ways.b, reach.r FROM reach
    JOIN ways ON ways.a = reach.doc_id),
  sets AS (SELECT n.doc_id, n.n, md5(string_agg(s.s, chr(10) ORDER BY s.s)) AS print FROM n JOIN s USING (doc_id)
    GROUP BY n.doc_id, n.n)
  SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
    coalesce(k.class_id, d.doc_id) AS class_id FROM documents d LEFT JOIN n USING (doc_id)
  LEFT JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id) LEFT
    JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY print) AS class_id FROM sets) k USING (doc_id)"""

#: The links of every document, by the same sets and links as above.
OP2_LINKS = (
    OP2[: OP2.index(",\n  ways AS")].replace("WITH RECURSIVE", "WITH")
    + """ SELECT doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links FROM documents LEFT
        JOIN (SELECT doc_id, count(*) AS k FROM (SELECT a AS doc_id FROM links UNION ALL SELECT b FROM links)
        GROUP BY doc_id) USING (doc_id)"""
)

OP5 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL),
  u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
    WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e,
    lambda x: x <> 0)) > 0),
  ways AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a
    JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
  reach AS (SELECT DISTINCT a AS vec_id, a AS r FROM ways UNION SELECT ways.b, reach.r FROM reach
    JOIN ways ON ways.a = reach.vec_id)
  SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c,
    vec_id) AS kept FROM embeddings
  LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY a) USING (vec_id) LEFT
    JOIN (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id) USING (vec_id)"""

OP7 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS s
    FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
  first AS (SELECT s, min(doc_id) AS first FROM p WHERE s IS NOT NULL GROUP BY s),
  f AS (SELECT p.*, CASE WHEN first.first < p.doc_id THEN 1 ELSE 0 END AS hit FROM p LEFT JOIN first USING (s)),
  g AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
    AS gone FROM f),
  k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word,
    ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept,
    '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

#: The table of CRC-32 by its rule, eight halvings of each of the 256 bytes.
_CRC = "SELECT i, i AS c FROM range(256) AS r(i)"
for _ in range(8):
    _CRC = f"SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({_CRC})"
_BARE = "[^\\x20\\x09-\\x0D]"

#: Edits row by row: of the ways to reach each state of the pattern, the cheapest and then ASCII-least edits stay.
OP12 = f"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS crc FROM ({_CRC})),
  raw AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text,
    ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR),
    ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
    FROM conversations),
  fated AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, b: xor(a >> 8,
    crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fate FROM raw, crc),
  hurt AS (SELECT g, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM fated, range(CASE WHEN fate = 3 THEN 2 ELSE 1 END) WHERE fate <> 0),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
  rows_ AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text,
    '{_BARE}') THEN 'b' WHEN row_number() OVER (PARTITION BY g, role,
    text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_extract(text, '({_BARE})[\\x20\\x09-\\x0D]*$', 1) IN ('.', '!',
    '?') THEN 't' ELSE 'f' END AS kind FROM numbered),
  steps AS (FROM (VALUES ('o', 's', 's'), ('o', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')) AS x("at",
    initial, into_)),
  paths AS (FROM (VALUES ('o', '', 'o', 0, []), ('o', 'I', 'u', 5, ['user:']), ('o', 'II', 'a', 10, ['user:',
    'assistant:']), ('s', '', 's', 0, []), ('s', 'I', 'u', 5, ['user:']), ('s', 'II', 'a', 10, ['user:', 'assistant:']),
    ('u', '', 'u', 0, []), ('u', 'I', 'a', 5, ['assistant:']), ('a', '', 'a', 0, []), ('a', 'I', 'u', 5,
    ['user:'])) AS x(state, letters, "at", cost, given)),
  moves AS (SELECT state, letters || 'D' AS letters, 'D' AS letter, NULL AS initial, "at" AS into_, cost + 2 AS cost,
    given FROM paths
    UNION ALL SELECT state, letters || 'K', 'K', initial, into_, cost, given FROM paths JOIN steps USING ("at")
    UNION ALL SELECT state, letters || 'R', 'R', initial, into_, cost + 1, given FROM paths JOIN steps USING ("at")
    WHERE initial <> 's'),
  walk AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, 'o' AS state, 0 AS cost, '' AS audit,
    CAST([] AS VARCHAR[]) AS said FROM raw
    UNION ALL SELECT g, i, state, cost, audit, said
    FROM (SELECT w.g, r.i, m.into_ AS state, w.cost + m.cost + CASE WHEN r.kind = 't' AND m.letter <> 'D' THEN 5 ELSE 0
    END AS cost, w.audit || m.letters AS audit,
      list_concat(list_concat(w.said, m.given),
    CASE m.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE m.initial WHEN 'u' THEN 'user:'
    ELSE 'assistant:' END || r.text] END) AS said,
      row_number() OVER (PARTITION BY w.g,
    m.into_ ORDER BY w.cost + m.cost + CASE WHEN r.kind = 't' AND m.letter <> 'D' THEN 5 ELSE 0 END,
    w.audit || m.letters) AS n
      FROM walk w JOIN rows_ r ON r.g = w.g AND r.i = w.i + 1
    JOIN moves m ON m.state = w.state AND (m.letter = 'D' OR r.kind NOT IN ('b',
    'd') AND (m.letter = 'R' OR m.initial = r.initial))) WHERE n = 1),
  ends AS (SELECT w.g, w.cost + p.cost AS cost, w.audit || p.letters AS audit, list_concat(w.said, p.given) AS said
    FROM walk w JOIN (SELECT g, max(i) AS i FROM walk GROUP BY g) USING (g, i)
    JOIN paths p ON p.state = w.state AND p."at" IN ('o', 'a')),
  best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, audit) = 1),
  pairs AS (SELECT g, kind, turn, lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS pair FROM rows_),
  counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate,
    count(*) FILTER (kind = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs
    GROUP BY g)
  SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate,
    0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost,
    audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
  FROM (SELECT DISTINCT g, conv_id FROM raw) o JOIN best USING (g) LEFT JOIN counts USING (g)"""

#: Exact sums of op11's whole numbers, in 128 bits.
OP11_DEVIATIONS = """WITH good AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding,
    lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS HUGEINT) + 100000) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding,
    lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  flat AS (SELECT r, vec_id, i, x[i] AS x FROM good, unnest(range(1, len(x) + 1)) AS d(i)),
    sums AS (SELECT i, sum(x) AS s FROM flat GROUP BY i), n AS (SELECT count(*) AS n FROM good)
  SELECT any_value(vec_id) AS vec_id, CAST(any_value(n) AS BIGINT) AS n,
    CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM flat JOIN sums USING (i), n GROUP BY r"""

#: Places of op13's phrases among the words.
OP13_PHRASES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER},
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  p AS (SELECT r, i - 1 AS place, CASE WHEN w[i] = 'mit' THEN 'mit' WHEN w[i] = 'apache' THEN 'apache' ELSE 'gpl' END AS
    label FROM d, unnest(range(1, len(w))) AS q(i)
    WHERE w[i] IN ('mit', 'apache') AND w[i + 1] = 'license' OR w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] =
    'license')
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels,
    '') AS base_labels FROM d LEFT JOIN (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r) USING (r)"""

ORACLES = {
    "op2_ngram_jaccard_join": OP2,
    "op2_ngram_jaccard_links": OP2_LINKS,
    "op5_embedding_near_dedup": OP5,
    "op7_substring_dedup": OP7,
    "op11_embedding_deviations": OP11_DEVIATIONS,
    "op12_conversation_repair": OP12,
    "op13_license_phrases": OP13_PHRASES,
}
