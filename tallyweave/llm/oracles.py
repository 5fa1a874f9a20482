"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH docs AS (SELECT DISTINCT doc_id, text, md5(text) AS th FROM documents WHERE text IS NOT NULL),
lines AS (
    SELECT doc_id, th, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM docs
),
worded AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines
),
placed AS (
    SELECT *, sum(words) OVER up - words AS above, sum(words) OVER (PARTITION BY doc_id, th) AS total,
           row_number() OVER up AS place
    FROM worded WHERE words > 0
    WINDOW up AS (PARTITION BY doc_id, th ORDER BY pos)
),
runs AS (
    SELECT *, list(line) OVER ahead AS begun, max(pos) OVER ahead AS begun_last,
           list(line) OVER back AS ended, min(pos) OVER back AS ended_first, min(place) OVER back AS ended_place
    FROM (SELECT *, total - above - words AS below FROM placed)
    WINDOW ahead AS (PARTITION BY doc_id, th ORDER BY above RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
           back AS (PARTITION BY doc_id, th ORDER BY below RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
windows AS (
    SELECT doc_id, th, pos AS first, begun_last AS last, place, begun AS content FROM runs WHERE total - above >= 50
    UNION ALL
    SELECT doc_id, th, ended_first, pos, ended_place, list_reverse(ended) FROM runs WHERE above + words >= 50
),
ranked AS (
    SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, th, place) AS nth FROM windows
),
gone AS (
    SELECT DISTINCT doc_id, th, unnest(range(first, last + 1)) AS pos FROM ranked WHERE nth > 1
),
islands AS (
    SELECT doc_id, th, min(pos) AS first, max(pos) AS last
    FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, th ORDER BY pos) AS island FROM gone)
    GROUP BY doc_id, th, island
),
ranges AS (
    SELECT doc_id, th, sum(last - first + 1) AS n_deleted, string_agg(first || '-' || last, ',' ORDER BY first) AS deleted
    FROM islands GROUP BY doc_id, th
),
kept AS (
    SELECT l.doc_id, l.th, count(*) AS n_lines,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
    FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.th = g.th AND l.pos = g.pos
    GROUP BY l.doc_id, l.th
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_deleted, 0)::BIGINT AS n_deleted,
       coalesce(r.deleted, '') AS deleted, md5(k.text) AS kept_md5
FROM documents d
LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(d.text) = k.th
LEFT JOIN ranges r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND md5(d.text) = r.th
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE good AS (
    SELECT row_number() OVER (ORDER BY vec_id, label) AS rid, vec_id, label, embedding::DOUBLE[] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
links AS (
    SELECT a.rid AS a, b.rid AS b
    FROM good a JOIN good b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
),
reach AS (
    SELECT rid AS a, rid AS b FROM good
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
found AS (
    SELECT g.rid, min(h.vec_id) AS component_id
    FROM good g JOIN reach r ON r.a = g.rid JOIN good h ON h.rid = r.b GROUP BY g.rid
),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT g.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, f.component_id, coalesce(g.vec_id = f.component_id, false) AS kept
FROM good g JOIN found f ON f.rid = g.rid LEFT JOIN degree d ON d.a = g.rid
UNION ALL
SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings
WHERE NOT coalesce(label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding), false)
"""

# crc32 byte by byte from its table: no built-in gives it
PREFIX_TRIE = """
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY i) AS t
    FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
          FROM (SELECT unnest(range(256)) AS i))
),
own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
    SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                           lambda a, b: xor(a // 256, t.t[xor(a % 256, b) + 1])), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM own) c, crc_table t
),
rebuilt AS (
    SELECT i.conv_id, o.role, o.text, 0 AS part, o.place FROM ids i JOIN own o ON o.conv_id = i.base AND o.place <= i.h
    UNION ALL
    SELECT i.conv_id, o.role, o.text, 1, o.place FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.h
),
turns AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM rebuilt
),
sizes AS (SELECT i.conv_id, count(t.depth) AS n FROM ids i LEFT JOIN turns t USING (conv_id) GROUP BY i.conv_id),
begun AS (
    SELECT conv_id, depth, length(text) AS size, list(length(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
    UNION ALL
    SELECT conv_id, 0, 0, []::VARCHAR[] FROM ids
),
nodes AS (
    SELECT path, min(b.conv_id) AS conv_id, any_value(depth) AS depth, any_value(size) AS size, count(*) AS n_convs,
           sha256(coalesce(string_agg(b.conv_id::VARCHAR, ',' ORDER BY b.conv_id) FILTER (s.n = b.depth), '')) AS ends_sha256
    FROM begun b JOIN sizes s ON s.conv_id = b.conv_id GROUP BY path
),
known AS (SELECT b.conv_id AS member, n.* FROM begun b JOIN nodes n ON b.path = n.path),
kin AS (
    SELECT k.conv_id, k.depth, count(*) AS n_children
    FROM nodes n JOIN known k ON k.member = n.conv_id AND k.depth = n.depth - 1 GROUP BY k.conv_id, k.depth
),
below AS (
    SELECT k.conv_id, k.depth, sum((n.n_convs - 1) * n.size) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
    FROM nodes n JOIN known k ON k.member = n.conv_id AND k.depth <= n.depth
    LEFT JOIN kin c ON c.conv_id = n.conv_id AND c.depth = n.depth
    GROUP BY k.conv_id, k.depth
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.conv_id = n.conv_id AND b.depth = n.depth
LEFT JOIN kin c ON c.conv_id = n.conv_id AND c.depth = n.depth
LEFT JOIN known p ON p.member = n.conv_id AND p.depth = n.depth - 1
"""

NEAREST = """
WITH good AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
met AS (
    SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id,
           sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
                            lambda a, b: a + b)) AS score
    FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score, vec_id) AS rank FROM met)
SELECT query_id, rank::INT AS rank, vec_id, score FROM placed WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINE_DEDUP, "op8_embedding_dedup": EMBEDDING_DEDUP, "op11_prefix_trie": PREFIX_TRIE, "op13_nearest": NEAREST}
