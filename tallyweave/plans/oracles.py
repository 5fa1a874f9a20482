"""DuckDB SQL for the registered queries, written from the definitions and not from the plans.

``_INPUT`` maps the driver tables onto the six target tables; each query adds its own steps.
"""

from __future__ import annotations

_ITEMS = range(20)

_INPUT = """
WITH log AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d,
         coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM events),
bought AS (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS raw, event_id, user_id, k, prior
  FROM log WHERE event_type = 'purchase'),
done AS (
  SELECT b.raw, l.user_id, b.raw * 100 + l.d AS session_id, l.event_id, l.ts, l.k, l.event_type
  FROM log l JOIN bought b ON l.user_id = b.user_id AND l.prior = b.prior
  WHERE l.event_type <> 'purchase'),
counts AS (
  SELECT (SELECT count(*) FROM bought) AS p, (SELECT count(DISTINCT conv_id) FROM conversations) AS n),
links AS (
  SELECT conv_id AS conversation_id,
         greatest(((2 * (conv_id - CASE WHEN conv_id % 4 = 1 THEN 1 ELSE 0 END) + 1) * p) // (2 * n) - 1, 0) AS raw
  FROM (SELECT DISTINCT conv_id FROM conversations), counts),
rows_raw AS (
  SELECT DISTINCT raw, user_id, CAST(NULL AS BIGINT) AS conversation_id, session_id, 1 AS place FROM done
  UNION ALL
  SELECT l.raw, b.user_id, l.conversation_id, NULL, CASE WHEN l.conversation_id % 2 = 0 THEN 0 ELSE 2 END
  FROM links l JOIN bought b ON b.raw = l.raw),
timeline AS (
  SELECT raw, user_id, dense_rank() OVER (ORDER BY raw) - 1 AS purchase_event_id, conversation_id, session_id,
         row_number() OVER (PARTITION BY raw ORDER BY place, coalesce(session_id, conversation_id)) AS event_number
  FROM rows_raw),
users AS (SELECT user_id, purchase_event_id, conversation_id, session_id, event_number FROM timeline),
sessions AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS action_number,
         CASE WHEN k % 3 = 0 THEN 'o' || (event_id % (1 + 20 * k))
              ELSE 's' || (k % 10) || ',o' || (event_id % (1 + 20 * k)) || ',t_' || event_type END AS action_tags
  FROM done),
conv_keyword AS (
  SELECT conv_id AS conversation_id, turn AS sentence_number,
         CASE WHEN role = 'user' THEN 'user' ELSE 'agent' END AS sentence_speaker,
         array_to_string(list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '),
                                     lambda w: length(w) >= 3), ',') AS keywords
  FROM conversations),
conv_embedding AS (
  SELECT c.conv_id AS conversation_id, c.turn AS sentence_number, e.embedding
  FROM conversations c
  JOIN embeddings e ON e.vec_id = (c.conv_id * 31 + c.turn * 7) % (SELECT count(*) FROM embeddings)),
purchase_events AS (
  SELECT DISTINCT t.purchase_event_id, CAST(x.item AS VARCHAR) AS item_id
  FROM (SELECT DISTINCT raw, purchase_event_id FROM timeline) t
  JOIN (SELECT raw, k % 20 AS item FROM bought
        UNION ALL SELECT raw, event_id % 20 FROM bought WHERE event_id % 3 = 0) x ON x.raw = t.raw),
items AS (SELECT i AS item, CAST(i AS VARCHAR) AS item_id FROM range(20) r(i)),
event_ids AS (SELECT DISTINCT purchase_event_id FROM users),
post_filter AS (
  SELECT e.purchase_event_id, i.item_id FROM event_ids e, items i
  WHERE (i.item + e.purchase_event_id) % 4 <> 0
  UNION SELECT purchase_event_id, item_id FROM purchase_events),
cut AS (SELECT CAST(round_even(count(*) * CAST(0.9 AS DOUBLE), 0) AS BIGINT) AS id FROM event_ids),
train AS (SELECT * FROM users WHERE purchase_event_id < (SELECT id FROM cut)),
test AS (SELECT * FROM users WHERE purchase_event_id >= (SELECT id FROM cut)),
types AS (
  SELECT purchase_event_id,
         CASE WHEN bool_and(session_id IS NULL) THEN 'conversation'
              WHEN bool_and(session_id IS NOT NULL) THEN 'session' ELSE 'intersection' END AS event
  FROM users GROUP BY purchase_event_id),
train_types AS (SELECT * FROM types WHERE purchase_event_id < (SELECT id FROM cut)),
test_types AS (SELECT * FROM types WHERE purchase_event_id >= (SELECT id FROM cut)),
train_labels AS (SELECT * FROM purchase_events WHERE purchase_event_id < (SELECT id FROM cut)),
test_labels AS (SELECT * FROM purchase_events WHERE purchase_event_id >= (SELECT id FROM cut)),
runs AS (SELECT r AS run FROM range(1, 6) t(r))"""

_SCORES = """,
scores AS (
  SELECT m.model, r.run, e.purchase_event_id, i.item_id,
         ((e.purchase_event_id * 31 + i.item * 17 + r.run * 7 + 13 * m.model) % 101) / CAST(100 AS DOUBLE) AS score
  FROM event_ids e, items i, runs r, (VALUES (0), (1), (2)) m(model)),
masked AS (
  SELECT s.model, s.run, s.purchase_event_id, s.item_id,
         CASE WHEN p.item_id IS NULL THEN 0.0 ELSE s.score END AS score
  FROM scores s LEFT JOIN post_filter p USING (purchase_event_id, item_id)),
test_masked AS (
  SELECT * EXCLUDE (model) FROM masked WHERE model = 0 AND purchase_event_id >= (SELECT id FROM cut)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run, purchase_event_id ORDER BY score DESC, item_id) AS rank
  FROM test_masked)"""

# one row per run, event and cutoff, with the labels hit among the first k
_METRICS = (
    _SCORES
    + """,
judged AS (
  SELECT r.run, r.purchase_event_id, r.rank, CASE WHEN l.item_id IS NULL THEN 0 ELSE 1 END AS rel
  FROM ranked r LEFT JOIN test_labels l USING (purchase_event_id, item_id)),
at_rank AS (
  SELECT j.*, (SELECT sum(i.rel) FROM judged i
               WHERE i.run = j.run AND i.purchase_event_id = j.purchase_event_id AND i.rank <= j.rank) AS hits
  FROM judged j WHERE j.rank <= 5),
sizes AS (SELECT purchase_event_id, count(*) AS n_labels FROM test_labels GROUP BY 1),
measures AS (
  SELECT a.run, a.purchase_event_id, c.k,
         CAST(max(rel) AS DOUBLE) AS hit,
         sum(rel) / CAST(c.k AS DOUBLE) AS precision,
         sum(rel) / CAST(any_value(n_labels) AS DOUBLE) AS recall,
         coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0.0) AS reciprocal_rank,
         sum(rel * hits / CAST(rank AS DOUBLE)) / least(c.k, any_value(n_labels)) AS average_precision
  FROM at_rank a JOIN range(1, 6) c(k) ON a.rank <= c.k LEFT JOIN sizes s USING (purchase_event_id)
  GROUP BY a.run, a.purchase_event_id, c.k)"""
)

_ACTIONS = """,
actions AS (
  SELECT u.purchase_event_id, u.event_number, u.session_id, s.action_number, s.action_tags,
         u.purchase_event_id < (SELECT id FROM cut) AS is_train
  FROM users u LEFT JOIN sessions s USING (session_id) WHERE u.session_id IS NOT NULL),
tags AS (
  SELECT purchase_event_id, event_number, session_id, action_number, is_train,
         unnest(string_split(action_tags, ',')) AS feature,
         generate_subscripts(string_split(action_tags, ','), 1) AS place
  FROM actions),
fit AS (
  SELECT feature, count(*) AS n,
         count(*) / CAST((SELECT count(*) FROM (SELECT DISTINCT purchase_event_id, session_id, action_number
                                                FROM actions WHERE is_train)) AS DOUBLE) AS share
  FROM tags WHERE is_train GROUP BY feature),
kept AS (SELECT t.* FROM tags t JOIN fit f USING (feature) WHERE f.share >= 0.001),
emptied AS (
  SELECT DISTINCT purchase_event_id, is_train FROM actions
  WHERE purchase_event_id NOT IN (SELECT purchase_event_id FROM kept)),
has_empty AS (SELECT count(*) > 0 AS yes FROM emptied WHERE is_train),
hot AS (
  SELECT DISTINCT purchase_event_id, event_number, session_id, feature, is_train FROM kept
  UNION ALL
  SELECT purchase_event_id, NULL, NULL, CASE WHEN (SELECT yes FROM has_empty) THEN '' END, is_train FROM emptied),
steps AS (
  SELECT DISTINCT purchase_event_id, event_number, session_id, is_train FROM hot),
slots AS (
  SELECT *, count(*) OVER (PARTITION BY purchase_event_id) AS n_steps,
         row_number() OVER (PARTITION BY purchase_event_id ORDER BY event_number NULLS LAST, session_id) AS position
  FROM steps),
longest AS (SELECT is_train, max(n_steps) AS m FROM slots GROUP BY is_train),
placed AS (
  SELECT s.purchase_event_id, m - n_steps + position AS slot, n_steps, position, s.is_train, s.session_id
  FROM slots s JOIN longest l USING (is_train)),
slot_features AS (
  SELECT p.purchase_event_id, p.slot, p.n_steps, h.feature, p.is_train
  FROM placed p JOIN hot h ON h.purchase_event_id = p.purchase_event_id
                          AND h.session_id IS NOT DISTINCT FROM p.session_id)"""

_VECTORS = """,
sentences AS (
  SELECT conversation_id, sentence_number, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos
  FROM conv_embedding),
event_vec AS (
  SELECT u.purchase_event_id, s.pos, avg(CAST(s.value AS DOUBLE)) AS value
  FROM users u JOIN sentences s USING (conversation_id) GROUP BY 1, 2),
conv_vec AS (
  SELECT u.purchase_event_id, u.event_number, u.conversation_id, s.pos, avg(CAST(s.value AS DOUBLE)) AS value
  FROM users u JOIN sentences s USING (conversation_id) GROUP BY 1, 2, 3, 4)"""

_KEYWORDS = """,
both_raw AS (
  SELECT u.purchase_event_id, u.event_number, u.conversation_id, CAST(NULL AS BIGINT) AS session_id,
         k.sentence_number AS number, k.keywords
  FROM users u JOIN conv_keyword k USING (conversation_id)
  UNION ALL
  SELECT u.purchase_event_id, u.event_number, NULL, u.session_id, s.action_number, s.action_tags
  FROM users u JOIN sessions s USING (session_id)),
both_rows AS (SELECT * FROM both_raw WHERE keywords IS NOT NULL AND keywords <> ''),
words AS (
  SELECT purchase_event_id, event_number, conversation_id, session_id, number,
         unnest(string_split(keywords, ',')) AS feature
  FROM both_rows),
word_fit AS (
  SELECT feature, count(*) / CAST((SELECT count(*) FROM (
           SELECT DISTINCT purchase_event_id, conversation_id, session_id, number FROM both_rows
           WHERE purchase_event_id < (SELECT id FROM cut))) AS DOUBLE) AS share
  FROM words WHERE purchase_event_id < (SELECT id FROM cut) GROUP BY feature),
word_kept AS (
  SELECT DISTINCT purchase_event_id, event_number, conversation_id, session_id, feature
  FROM words JOIN word_fit USING (feature) WHERE share >= 0.001),
word_empty AS (
  SELECT count(*) > 0 AS yes FROM both_rows
  WHERE purchase_event_id < (SELECT id FROM cut)
    AND purchase_event_id NOT IN (SELECT purchase_event_id FROM word_kept))"""

_ANCHORS = """,
quota AS (
  SELECT item_id, CAST(greatest(round_even(count(*) / CAST((SELECT count(*) FROM train_labels) AS DOUBLE) * 125, 0), 1)
                       AS BIGINT) AS quota
  FROM train_labels GROUP BY item_id),
candidates AS (
  SELECT t.purchase_event_id FROM train t JOIN types y USING (purchase_event_id)
  WHERE y.event = 'intersection' GROUP BY t.purchase_event_id HAVING count(*) = 2),
classes AS (
  SELECT DISTINCT ON (c.purchase_event_id) c.purchase_event_id, l.item_id AS class, q.quota
  FROM candidates c JOIN train_labels l USING (purchase_event_id) JOIN quota q USING (item_id)
  ORDER BY c.purchase_event_id, q.quota, l.item_id),
sampled AS (
  SELECT purchase_event_id, class FROM (
    SELECT *, row_number() OVER (PARTITION BY class ORDER BY
             ((purchase_event_id % 2147483647) * 48271 + 42) % 2147483647, purchase_event_id) AS r FROM classes)
  WHERE r <= quota),
anchors AS (SELECT row_number() OVER (ORDER BY purchase_event_id) AS anchor_pos, * FROM sampled)"""

_RELATIVE = (
    _ACTIONS
    + _VECTORS
    + _ANCHORS
    + """,
conv_list AS (
  SELECT purchase_event_id, event_number, conversation_id, list(value ORDER BY pos) AS v FROM conv_vec GROUP BY 1, 2, 3),
step_list AS (
  SELECT purchase_event_id, event_number, session_id, is_train,
         list(DISTINCT feature) FILTER (feature IS NOT NULL) AS f FROM hot GROUP BY 1, 2, 3, 4),
relative AS (
  SELECT c.purchase_event_id, c.event_number, c.conversation_id, CAST(NULL AS BIGINT) AS session_id,
         CAST(1 AS BIGINT) AS conversation_ind, a.anchor_pos - 1 AS pos, list_cosine_similarity(c.v, x.v) AS value
  FROM conv_list c, anchors a JOIN conv_list x ON x.purchase_event_id = a.purchase_event_id
  UNION ALL
  SELECT s.purchase_event_id, s.event_number, NULL, s.session_id, 0, a.anchor_pos - 1,
         coalesce(len(list_intersect(s.f, x.f)) / sqrt(CAST(nullif(len(s.f), 0) * nullif(len(x.f), 0) AS DOUBLE)), 0.0)
  FROM step_list s, anchors a JOIN step_list x ON x.purchase_event_id = a.purchase_event_id)"""
)

_GENERATOR = """,
both_ids AS (SELECT purchase_event_id FROM train_types WHERE event = 'intersection'),
pair_fit AS (
  SELECT feature, count(*) / CAST((SELECT count(*) FROM (
           SELECT DISTINCT purchase_event_id, session_id, action_number
           FROM actions SEMI JOIN both_ids USING (purchase_event_id))) AS DOUBLE) AS share
  FROM tags SEMI JOIN both_ids USING (purchase_event_id) GROUP BY feature),
pair_hot AS (
  SELECT DISTINCT purchase_event_id, event_number, session_id, feature
  FROM tags SEMI JOIN both_ids USING (purchase_event_id) JOIN pair_fit USING (feature) WHERE share >= 0.001),
pair_empty AS (
  SELECT purchase_event_id FROM both_ids WHERE purchase_event_id NOT IN (SELECT purchase_event_id FROM pair_hot)),
pair_all AS (
  SELECT * FROM pair_hot UNION ALL SELECT purchase_event_id, NULL, NULL, '' FROM pair_empty),
pair_class AS (
  SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS position FROM (SELECT DISTINCT feature FROM pair_all)),
width AS (SELECT count(*) AS n FROM pair_class),
event_pos AS (
  SELECT purchase_event_id, pos, value FROM event_vec SEMI JOIN both_ids USING (purchase_event_id)),
any_step AS (SELECT DISTINCT purchase_event_id, position FROM pair_all JOIN pair_class USING (feature)),
recent AS (
  SELECT purchase_event_id, event_number, session_id,
         row_number() OVER (PARTITION BY purchase_event_id ORDER BY event_number DESC NULLS FIRST, session_id DESC) - 1 AS age
  FROM (SELECT DISTINCT purchase_event_id, event_number, session_id FROM pair_all))"""

_SQUARES = (
    _VECTORS
    + """, xs AS (SELECT purchase_event_id, pos AS c, value AS v FROM event_vec WHERE purchase_event_id < (SELECT id FROM cut)
           UNION ALL SELECT DISTINCT purchase_event_id, 64, 1.0 FROM event_vec WHERE purchase_event_id < (SELECT id FROM cut))"""
)

_CONTEXTS = (
    _ACTIONS
    + """,
symbols AS (
  SELECT s.purchase_event_id, s.is_train, l.m - s.slot AS age,
         min(struct_pack(n := coalesce(f.n, 0), name := coalesce(s.feature, ''))).name AS symbol
  FROM slot_features s JOIN longest l USING (is_train) LEFT JOIN fit f USING (feature)
  GROUP BY s.purchase_event_id, s.is_train, l.m, s.slot),
context AS (
  SELECT purchase_event_id, is_train, d AS depth, string_agg(symbol, '>' ORDER BY age) AS context
  FROM symbols, range(1, 4) t(d) WHERE age < d GROUP BY purchase_event_id, is_train, d HAVING count(*) = d
  UNION ALL SELECT DISTINCT purchase_event_id, is_train, 0, '' FROM symbols),
context_n AS (SELECT depth, context, count(*) AS n FROM context WHERE is_train GROUP BY depth, context),
context_k AS (
  SELECT depth, context, item_id, count(*) AS n
  FROM context JOIN train_labels USING (purchase_event_id) WHERE is_train GROUP BY depth, context, item_id)"""
)

_WIDE = ", ".join(f"CAST(max(CASE WHEN item_id = '{i}' THEN 1 ELSE 0 END) AS BIGINT) AS item_{i}" for i in _ITEMS)


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _mean(column: str, name: str) -> str:
    return _r(f"avg({column})", name)


_BODIES: dict[str, tuple[str, str]] = {
    "scan_timeline": ("", "SELECT * FROM users"),
    "embedding_pack": (
        _VECTORS,
        f"SELECT conversation_id, sentence_number, pos, {_r('CAST(value AS DOUBLE)', 'value')} FROM sentences",
    ),
    "timeline_checks": (
        "",
        """SELECT 'dense event ids from 0' AS promise,
                  (SELECT max(purchase_event_id) + 1 - count(*) + abs(min(purchase_event_id)) FROM event_ids) AS violations
           UNION ALL SELECT 'one id per row', (SELECT count(*) FROM users
                  WHERE (conversation_id IS NULL) = (session_id IS NULL))
           UNION ALL SELECT 'an item bought per event', (SELECT count(*) FROM event_ids
                  WHERE purchase_event_id NOT IN (SELECT purchase_event_id FROM purchase_events))
           UNION ALL SELECT 'an item on sale per event', (SELECT count(*) FROM event_ids
                  WHERE purchase_event_id NOT IN (SELECT purchase_event_id FROM post_filter))""",
    ),
    "holdout_train": ("", "SELECT * FROM train"),
    "holdout_test": ("", "SELECT * FROM test"),
    "validation_split": (
        "",
        """SELECT purchase_event_id,
                  CAST(row_number() OVER (ORDER BY purchase_event_id DESC) <= ceil(count(*) OVER () * CAST(0.1 AS DOUBLE))
                       AS BIGINT) AS is_validation
           FROM train_types""",
    ),
    "validation_tail": (
        "",
        """SELECT purchase_event_id, event_number, conversation_id,
                  CAST(row_number() OVER (ORDER BY purchase_event_id DESC, event_number DESC, conversation_id DESC)
                       <= ceil(count(*) OVER () * CAST(0.1 AS DOUBLE)) AS BIGINT) AS is_validation
           FROM train WHERE conversation_id IS NOT NULL""",
    ),
    "timeline_actions": (
        _ACTIONS,
        "SELECT purchase_event_id, event_number, session_id, action_number, action_tags FROM actions WHERE is_train",
    ),
    "timeline_sentences": (
        "",
        """SELECT t.purchase_event_id, t.event_number, t.conversation_id, k.sentence_number, k.sentence_speaker, k.keywords
           FROM train t LEFT JOIN conv_keyword k USING (conversation_id) WHERE t.conversation_id IS NOT NULL""",
    ),
    "conversation_labels": (
        "",
        """SELECT purchase_event_id, event_number, conversation_id, item_id
           FROM train JOIN train_labels USING (purchase_event_id) WHERE conversation_id IS NOT NULL""",
    ),
    "split_purchases": ("", "SELECT purchase_event_id, item_id FROM train_labels"),
    "missing_modality": (
        "",
        """SELECT purchase_event_id, 'session' AS missing FROM train GROUP BY 1 HAVING count(session_id) = 0
           UNION ALL
           SELECT purchase_event_id, 'conversation' FROM train GROUP BY 1 HAVING count(conversation_id) = 0""",
    ),
    "event_spine": (
        "",
        """SELECT purchase_event_id, event_number, session_id FROM train WHERE session_id IS NOT NULL
           UNION ALL
           SELECT purchase_event_id, NULL, NULL FROM train GROUP BY 1 HAVING count(session_id) = 0""",
    ),
    "event_type": ("", "SELECT purchase_event_id, event FROM types"),
    "event_type_share": (
        "",
        f"""SELECT event, count(*) AS n_events,
                   {_r('count(*) / CAST((SELECT count(*) FROM train_types) AS DOUBLE)', 'share')}
            FROM train_types GROUP BY event""",
    ),
    "sample_weights": (
        """, p AS (SELECT count(*) FILTER (event = 'conversation') / CAST(count(*) AS DOUBLE) AS c,
                          count(*) FILTER (event = 'session') / CAST(count(*) AS DOUBLE) AS s,
                          count(*) FILTER (event = 'intersection') / CAST(count(*) AS DOUBLE) AS i FROM train_types)""",
        f"""SELECT purchase_event_id, event,
                   {_r("CASE event WHEN 'conversation' THEN 2.0 WHEN 'session' THEN 1.0 ELSE (2 * c + s) / (1 - i) END", 'weight')}
            FROM train_types, p""",
    ),
    "distillation_weights": (
        "",
        f"""SELECT {_r("count(*) FILTER (event <> 'session') / CAST(count(*) AS DOUBLE)", 'alpha')},
                   {_r("count(*) FILTER (event <> 'conversation') / CAST(count(*) AS DOUBLE)", 'beta')}
            FROM train_types""",
    ),
    "feature_share": (_ACTIONS, f"SELECT feature, n, {_r('share', 'share')} FROM fit"),
    "pruned_tags": (
        _ACTIONS,
        """SELECT purchase_event_id, event_number, session_id, action_number,
                  string_agg(feature, ',' ORDER BY place) AS action_tags,
                  CASE WHEN is_train THEN 'train' ELSE 'test' END AS part
           FROM kept GROUP BY purchase_event_id, event_number, session_id, action_number, is_train
           UNION ALL
           SELECT purchase_event_id, NULL, NULL, NULL, '', CASE WHEN is_train THEN 'train' ELSE 'test' END FROM emptied""",
    ),
    "multi_hot_sessions": (
        _ACTIONS,
        "SELECT purchase_event_id, event_number, session_id, feature FROM hot WHERE is_train",
    ),
    "padded_sequences": (
        _ACTIONS,
        "SELECT purchase_event_id, slot, n_steps, feature FROM slot_features WHERE is_train",
    ),
    "sequences_from_chunks": (
        _ACTIONS,
        "SELECT purchase_event_id, slot, n_steps, feature FROM slot_features WHERE is_train",
    ),
    "shuffled_sequences": (
        _ACTIONS
        + """, drawn AS (
          SELECT *, (((7919 * 42 + coalesce(event_number, 0) + coalesce(session_id, 0)) % 2147483647 * 48271 + 42) % 2147483647
                     * 48271 + 42) % 2147483647 AS d
          FROM steps WHERE is_train),
        dealt AS (
          SELECT *, count(*) OVER (PARTITION BY purchase_event_id) AS n_steps,
                 row_number() OVER (PARTITION BY purchase_event_id ORDER BY d, event_number NULLS FIRST, session_id NULLS FIRST) AS p
          FROM drawn)""",
        """SELECT d.purchase_event_id, (SELECT max(n_steps) FROM dealt) - n_steps + p AS slot, n_steps, h.feature
           FROM dealt d JOIN hot h ON h.purchase_event_id = d.purchase_event_id
                AND h.session_id IS NOT DISTINCT FROM d.session_id AND h.event_number IS NOT DISTINCT FROM d.event_number""",
    ),
    "session_slots": (
        _ACTIONS,
        "SELECT purchase_event_id, slot, n_steps, feature FROM slot_features WHERE NOT is_train",
    ),
    "keyword_timeline": (
        _KEYWORDS,
        """SELECT purchase_event_id, event_number, conversation_id, session_id, number, keywords,
                  CASE WHEN purchase_event_id < (SELECT id FROM cut) THEN 'train' ELSE 'test' END AS part
           FROM both_rows
           UNION ALL
           SELECT DISTINCT purchase_event_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
                  CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'test'
           FROM test WHERE purchase_event_id NOT IN (SELECT purchase_event_id FROM both_rows)""",
    ),
    "keyword_features": (
        _KEYWORDS,
        """SELECT purchase_event_id, event_number, conversation_id, session_id,
                  CAST(session_id IS NULL AS BIGINT) AS conversation_ind, feature,
                  CASE WHEN purchase_event_id < (SELECT id FROM cut) THEN 'train' ELSE 'test' END AS part
           FROM word_kept
           UNION ALL
           SELECT DISTINCT purchase_event_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 1,
                  CASE WHEN (SELECT yes FROM word_empty) THEN '' END, 'test'
           FROM test WHERE purchase_event_id NOT IN (SELECT purchase_event_id FROM word_kept)
           UNION ALL
           SELECT DISTINCT purchase_event_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 1, '', 'train'
           FROM both_rows WHERE purchase_event_id < (SELECT id FROM cut)
             AND purchase_event_id NOT IN (SELECT purchase_event_id FROM word_kept)""",
    ),
    "event_embedding": (
        _VECTORS,
        f"""SELECT purchase_event_id, pos, {_r('value', 'value')} FROM event_vec
            WHERE purchase_event_id < (SELECT id FROM cut)""",
    ),
    "conversation_embedding": (
        _VECTORS,
        f"""SELECT purchase_event_id, event_number, conversation_id, pos, {_r('value', 'value')} FROM conv_vec
            WHERE purchase_event_id < (SELECT id FROM cut)""",
    ),
    "modality_union": ("", "SELECT purchase_event_id, event_number, conversation_id, session_id FROM train"),
    "joint_features": (
        _ACTIONS + _VECTORS,
        f"""SELECT purchase_event_id, event_number, conversation_id, CAST(NULL AS BIGINT) AS session_id,
                   CAST(1 AS BIGINT) AS conversation_ind, 'e' || pos AS name, {_r('value', 'value')}
            FROM conv_vec WHERE purchase_event_id < (SELECT id FROM cut) AND value <> 0
            UNION ALL
            SELECT purchase_event_id, coalesce(event_number, 0), NULL, session_id, 0,
                   't:' || feature, CASE WHEN feature IS NOT NULL THEN 1.0 END
            FROM hot WHERE is_train""",
    ),
    "impute_conversations": (
        _VECTORS
        + """, means AS (SELECT pos, avg(value) AS value FROM event_vec
                         WHERE purchase_event_id < (SELECT id FROM cut) GROUP BY pos)""",
        f"""SELECT t.purchase_event_id, m.pos, {_r('coalesce(v.value, m.value)', 'value')}
            FROM test_types t CROSS JOIN means m
            LEFT JOIN event_vec v ON v.purchase_event_id = t.purchase_event_id AND v.pos = m.pos""",
    ),
    "impute_sessions": (
        _ACTIONS
        + """, usual AS (SELECT feature FROM hot WHERE is_train AND feature IS NOT NULL GROUP BY feature
                         HAVING count(*) * 2 > (SELECT count(*) FROM steps WHERE is_train))""",
        """SELECT purchase_event_id, coalesce(event_number, 1) AS event_number, session_id, feature
           FROM hot WHERE NOT is_train
           UNION ALL
           SELECT t.purchase_event_id, 1, NULL, u.feature
           FROM (SELECT purchase_event_id FROM test GROUP BY 1 HAVING count(session_id) = 0) t
           LEFT JOIN usual u ON true""",
    ),
    "neutral_imputed": (
        _ACTIONS
        + _VECTORS
        + """, means AS (SELECT pos, avg(value) AS value FROM event_vec
                         WHERE purchase_event_id < (SELECT id FROM cut) GROUP BY pos),
        usual AS (SELECT feature FROM hot WHERE is_train AND feature IS NOT NULL GROUP BY feature
                  HAVING count(*) * 2 > (SELECT count(*) FROM steps WHERE is_train)),
        moment AS (SELECT t.purchase_event_id, sum(coalesce(v.value, m.value) * (m.pos + 1)) AS x
                   FROM test_types t CROSS JOIN means m
                   LEFT JOIN event_vec v ON v.purchase_event_id = t.purchase_event_id AND v.pos = m.pos GROUP BY 1),
        full_steps AS (
          SELECT purchase_event_id, coalesce(event_number, 1) AS event_number, session_id, count(feature) AS n_features
          FROM hot WHERE NOT is_train GROUP BY 1, 2, 3
          UNION ALL
          SELECT purchase_event_id, 1, NULL, (SELECT count(*) FROM usual) FROM test GROUP BY 1 HAVING count(session_id) = 0),
        full_slots AS (
          SELECT *, count(*) OVER (PARTITION BY purchase_event_id) AS n_steps,
                 row_number() OVER (PARTITION BY purchase_event_id ORDER BY event_number, session_id) AS position
          FROM full_steps)""",
        f"""SELECT s.purchase_event_id, (SELECT max(n_steps) FROM full_slots) - n_steps + position AS slot, n_steps,
                   n_features, {_r('m.x', 'embedding_moment')}
            FROM full_slots s JOIN moment m USING (purchase_event_id)""",
    ),
    "generator_moments_conversation": (
        _ACTIONS
        + _VECTORS
        + _GENERATOR
        + """, xs AS (SELECT purchase_event_id, position AS c, 1.0 AS v FROM any_step
                      UNION ALL SELECT purchase_event_id, (SELECT n FROM width), 1.0 FROM both_ids),
        ys AS (SELECT purchase_event_id, c, v FROM xs
               UNION ALL SELECT purchase_event_id, (SELECT n FROM width) + 1 + pos, value FROM event_pos),
        sums AS (SELECT x.c AS r, y.c AS c, sum(x.v * y.v) AS v FROM xs x JOIN ys y USING (purchase_event_id) GROUP BY 1, 2)""",
        f"""SELECT r.i AS row, c.i AS "column", {_r('coalesce(s.v, 0.0)', 'value')}
            FROM (SELECT unnest(range((SELECT n + 1 FROM width))) AS i) r
            CROSS JOIN (SELECT unnest(range((SELECT n + 1 + 64 FROM width))) AS i) c
            LEFT JOIN sums s ON s.r = r.i AND s.c = c.i""",
    ),
    "generator_moments_session": (
        _ACTIONS
        + _VECTORS
        + _GENERATOR
        + """, xs AS (SELECT purchase_event_id, age, pos AS c, value AS v FROM event_pos JOIN recent USING (purchase_event_id)
                      UNION ALL SELECT purchase_event_id, age, 64, 1.0 / (age + 1) FROM recent
                      UNION ALL SELECT purchase_event_id, age, 65, 1.0 FROM recent),
        ys AS (SELECT purchase_event_id, age, c, v FROM xs
               UNION ALL
               SELECT DISTINCT p.purchase_event_id, r.age, 66 + k.position, 1.0
               FROM recent r JOIN pair_all p ON p.purchase_event_id = r.purchase_event_id
                    AND p.session_id IS NOT DISTINCT FROM r.session_id
                    AND p.event_number IS NOT DISTINCT FROM r.event_number JOIN pair_class k USING (feature)),
        sums AS (SELECT x.c AS r, y.c AS c, sum(x.v * y.v) AS v FROM xs x JOIN ys y USING (purchase_event_id, age) GROUP BY 1, 2)""",
        f"""SELECT r.i AS row, c.i AS "column", {_r('coalesce(s.v, 0.0)', 'value')}
            FROM range(66) r(i) CROSS JOIN (SELECT unnest(range((SELECT 66 + n FROM width))) AS i) c
            LEFT JOIN sums s ON s.r = r.i AND s.c = c.i""",
    ),
    "item_labels": ("", "SELECT purchase_event_id, item_id FROM purchase_events"),
    "item_matrix": ("", f"SELECT purchase_event_id, {_WIDE} FROM test_labels GROUP BY purchase_event_id"),
    "item_popularity": ("", "SELECT item_id, count(*) AS n FROM train_labels GROUP BY item_id"),
    "popularity_scores": (
        ", popular AS (SELECT item_id, count(*) AS n FROM train_labels GROUP BY item_id)",
        """SELECT p.purchase_event_id, p.item_id, CAST(coalesce(n, 0) AS DOUBLE) AS score
           FROM post_filter p JOIN test_types USING (purchase_event_id) LEFT JOIN popular USING (item_id)""",
    ),
    "popularity_topk": (
        """, popular AS (SELECT item_id, count(*) AS n FROM train_labels GROUP BY item_id),
        dense AS (SELECT t.purchase_event_id, i.item_id,
                         CASE WHEN p.item_id IS NULL THEN 0.0 ELSE CAST(coalesce(n, 0) AS DOUBLE) END AS score
                  FROM test_types t CROSS JOIN items i LEFT JOIN popular USING (item_id)
                  LEFT JOIN post_filter p ON p.purchase_event_id = t.purchase_event_id AND p.item_id = i.item_id)""",
        """SELECT * FROM (SELECT purchase_event_id, item_id, score,
                  row_number() OVER (PARTITION BY purchase_event_id ORDER BY score DESC, item_id) AS rank FROM dense)
           WHERE rank <= 3""",
    ),
    "popularity_report": (
        """, popular AS (SELECT item_id, count(*) AS n FROM train_labels GROUP BY item_id),
        dense AS (SELECT t.purchase_event_id, i.item_id,
                         CASE WHEN p.item_id IS NULL THEN 0.0 ELSE CAST(coalesce(n, 0) AS DOUBLE) END AS score
                  FROM test_types t CROSS JOIN items i LEFT JOIN popular USING (item_id)
                  LEFT JOIN post_filter p ON p.purchase_event_id = t.purchase_event_id AND p.item_id = i.item_id),
        judged AS (SELECT r.purchase_event_id, r.rank, CASE WHEN l.item_id IS NULL THEN 0 ELSE 1 END AS rel
                   FROM (SELECT *, row_number() OVER (PARTITION BY purchase_event_id ORDER BY score DESC, item_id) AS rank
                         FROM dense) r LEFT JOIN test_labels l USING (purchase_event_id, item_id) WHERE r.rank <= 3),
        gains AS (SELECT *, rel * sum(rel) OVER (PARTITION BY purchase_event_id ORDER BY rank) / CAST(rank AS DOUBLE) AS g
                  FROM judged),
        sizes AS (SELECT purchase_event_id, count(*) AS n FROM test_labels GROUP BY 1),
        per_event AS (SELECT purchase_event_id, CAST(max(rel) AS DOUBLE) AS hit, sum(g) / least(3, any_value(n)) AS ap
                      FROM gains LEFT JOIN sizes USING (purchase_event_id) GROUP BY 1)""",
        f"""SELECT coalesce(event, 'union') AS event, count(*) AS n_events, {_mean('hit', 'hit_rate')},
                   {_mean('ap', 'mean_average_precision')}
            FROM test_types LEFT JOIN per_event USING (purchase_event_id) GROUP BY ROLLUP (event)""",
    ),
    "popularity_curve": (
        """, popular AS (SELECT item_id, count(*) AS n FROM train_labels GROUP BY item_id),
        dense AS (SELECT t.purchase_event_id, i.item_id,
                         CASE WHEN p.item_id IS NULL THEN 0.0 ELSE CAST(coalesce(n, 0) AS DOUBLE) END AS score
                  FROM test_types t CROSS JOIN items i LEFT JOIN popular USING (item_id)
                  LEFT JOIN post_filter p ON p.purchase_event_id = t.purchase_event_id AND p.item_id = i.item_id),
        judged AS (SELECT r.purchase_event_id, r.rank, CASE WHEN l.item_id IS NULL THEN 0 ELSE 1 END AS rel
                   FROM (SELECT *, row_number() OVER (PARTITION BY purchase_event_id ORDER BY score DESC, item_id) AS rank
                         FROM dense) r LEFT JOIN test_labels l USING (purchase_event_id, item_id)),
        gains AS (SELECT *, rel * sum(rel) OVER (PARTITION BY purchase_event_id ORDER BY rank) / CAST(rank AS DOUBLE) AS g
                  FROM judged),
        sizes AS (SELECT purchase_event_id, count(*) AS n FROM test_labels GROUP BY 1),
        per_event AS (SELECT purchase_event_id, k, CAST(max(rel) AS DOUBLE) AS hit, sum(g) / least(k, any_value(n)) AS ap
                      FROM gains JOIN range(1, 6) c(k) ON rank <= k LEFT JOIN sizes USING (purchase_event_id) GROUP BY 1, 2)""",
        f"""SELECT k, coalesce(event, 'union') AS event, {_mean('hit', 'hit_rate')}, {_mean('ap', 'mean_average_precision')}
            FROM test_types JOIN per_event USING (purchase_event_id) GROUP BY GROUPING SETS ((k, event), (k))""",
    ),
    "masked_scores": (_SCORES, f"SELECT run, purchase_event_id, item_id, {_r('score', 'score')} FROM test_masked"),
    "ranked_items": (_SCORES, f"SELECT run, purchase_event_id, item_id, {_r('score', 'score')}, rank FROM ranked"),
    "topk_items": (
        _SCORES,
        f"SELECT run, purchase_event_id, item_id, {_r('score', 'score')}, rank FROM ranked WHERE rank <= 3",
    ),
    **{
        query: (_METRICS, f"SELECT run, purchase_event_id, k, {_r(column, column)} FROM measures")
        for query, column in {
            "hit_at_k": "hit",
            "precision_at_k": "precision",
            "recall_at_k": "recall",
            "reciprocal_rank": "reciprocal_rank",
            "average_precision": "average_precision",
        }.items()
    },
    "metrics_by_type": (
        _METRICS,
        f"""SELECT m.run, coalesce(t.event, 'union') AS event, count(*) AS n_events, {_mean('hit', 'hit_rate')},
                   {_mean('average_precision', 'mean_average_precision')}
            FROM test_types t JOIN measures m USING (purchase_event_id) WHERE m.k = 3
            GROUP BY GROUPING SETS ((m.run, t.event), (m.run))""",
    ),
    "metrics_over_runs": (
        _METRICS
        + """, per_run AS (
          SELECT m.run, coalesce(t.event, 'union') AS event, avg(hit) AS h, avg(average_precision) AS a
          FROM test_types t JOIN measures m USING (purchase_event_id) WHERE m.k = 3
          GROUP BY GROUPING SETS ((m.run, t.event), (m.run)))""",
        f"""SELECT event, {_mean('h', 'hit_rate')}, {_mean('a', 'mean_average_precision')} FROM per_run GROUP BY event""",
    ),
    "map_by_k": (
        _METRICS
        + """, per_run AS (
          SELECT m.run, m.k, coalesce(t.event, 'union') AS event, avg(average_precision) AS a
          FROM test_types t JOIN measures m USING (purchase_event_id)
          GROUP BY GROUPING SETS ((m.run, m.k, t.event), (m.run, m.k)))""",
        "SELECT k, "
        + ", ".join(
            _r(f"avg(a) FILTER (event = '{e}')", f'"{e}"') for e in ("conversation", "intersection", "session", "union")
        )
        + " FROM per_run GROUP BY k",
    ),
    "macro_auc": (
        _SCORES
        + """, valid AS (
          SELECT purchase_event_id FROM (
            SELECT purchase_event_id, row_number() OVER (ORDER BY purchase_event_id DESC) AS r, count(*) OVER () AS n
            FROM train_types) WHERE r <= ceil(n * CAST(0.1 AS DOUBLE))),
        pairs AS (
          SELECT m.run, m.item_id, m.score, CASE WHEN l.item_id IS NULL THEN 0 ELSE 1 END AS y
          FROM masked m JOIN valid USING (purchase_event_id)
          LEFT JOIN train_labels l USING (purchase_event_id, item_id) WHERE m.model = 0),
        placed AS (
          SELECT *, rank() OVER (PARTITION BY run, item_id ORDER BY score)
                    + (count(*) OVER (PARTITION BY run, item_id, score) - 1) / 2.0 AS average_rank FROM pairs),
        per_item AS (
          SELECT run, item_id, sum(y) AS p, count(*) - sum(y) AS n, sum(CASE WHEN y = 1 THEN average_rank ELSE 0 END) AS s
          FROM placed GROUP BY run, item_id),
        aucs AS (
          SELECT run, CASE WHEN p > 0 AND n > 0
                           THEN (s - p * (p + 1) / 2.0) / CAST(p * n AS DOUBLE) END AS auc FROM per_item)""",
        f"""SELECT run, {_mean('auc', 'macro_auc')}, count(auc) AS n_items, count(*) - count(auc) AS n_skipped
            FROM aucs GROUP BY run""",
    ),
    "late_fusion": (
        _SCORES,
        f"""SELECT c.run, c.purchase_event_id, c.item_id,
                   {_r('''CASE WHEN p.item_id IS NULL THEN 0.0 WHEN t.event = 'conversation' THEN c.score
                        WHEN t.event = 'session' THEN s.score ELSE 0.5 * c.score + 0.5 * s.score END''', 'score')}
            FROM scores c JOIN scores s ON s.model = 1 AND s.run = c.run AND s.item_id = c.item_id
                 AND s.purchase_event_id = c.purchase_event_id
            JOIN test_types t ON t.purchase_event_id = c.purchase_event_id
            LEFT JOIN post_filter p ON p.purchase_event_id = c.purchase_event_id AND p.item_id = c.item_id
            WHERE c.model = 0""",
    ),
    "routed_scores": (
        _SCORES,
        f"""SELECT m.run, m.purchase_event_id, m.item_id, {_r('m.score', 'score')}
            FROM masked m JOIN test_types t USING (purchase_event_id)
            WHERE m.model = CASE t.event WHEN 'conversation' THEN 0 WHEN 'session' THEN 1 ELSE 2 END""",
    ),
    "distillation_targets": (
        _SCORES,
        f"""SELECT a.purchase_event_id, a.item_id, CAST(l.item_id IS NOT NULL AS DOUBLE) AS y,
                   {_r('a.score', 'z1')}, {_r('b.score', 'z2')}
            FROM scores a JOIN scores b USING (run, purchase_event_id, item_id)
            JOIN train_types t USING (purchase_event_id) LEFT JOIN train_labels l USING (purchase_event_id, item_id)
            WHERE a.run = 1 AND a.model = 0 AND b.model = 1 AND t.event = 'intersection'""",
    ),
    "distillation_loss": (
        _SCORES
        + """, w AS (SELECT count(*) FILTER (event <> 'session') / CAST(count(*) AS DOUBLE) AS alpha,
                            count(*) FILTER (event <> 'conversation') / CAST(count(*) AS DOUBLE) AS beta FROM train_types),
        joined AS (
          SELECT s.purchase_event_id, greatest(least(s.score, 1 - CAST(1e-7 AS DOUBLE)), CAST(1e-7 AS DOUBLE)) AS p,
                 CASE WHEN l.item_id IS NULL THEN 0.0 ELSE 1.0 END AS y, a.score AS z1, b.score AS z2
          FROM scores s JOIN scores a USING (run, purchase_event_id, item_id)
          JOIN scores b USING (run, purchase_event_id, item_id) JOIN train_types t USING (purchase_event_id)
          LEFT JOIN train_labels l USING (purchase_event_id, item_id)
          WHERE run = 1 AND s.model = 2 AND a.model = 0 AND b.model = 1 AND t.event = 'intersection')""",
        f"""SELECT purchase_event_id,
                   {_r('''avg(-(y * ln(p) + (1 - y) * ln(1 - p)))
                          + any_value(alpha) * avg(-(z1 * ln(p) + (1 - z1) * ln(1 - p)))
                          + any_value(beta) * avg(-(z2 * ln(p) + (1 - z2) * ln(1 - p)))''', 'loss')}
            FROM joined, w GROUP BY purchase_event_id""",
    ),
    "anchor_candidates": (_ANCHORS, "SELECT purchase_event_id FROM candidates"),
    "anchor_quota": (_ANCHORS, "SELECT item_id, quota FROM quota"),
    "anchor_class": (_ANCHORS, "SELECT purchase_event_id, class, quota FROM classes"),
    "anchor_sample": (_ANCHORS, "SELECT anchor_pos, purchase_event_id, class FROM anchors"),
    "anchor_shortfall": (
        _ANCHORS,
        """SELECT item_id, quota, quota - count(c.class) AS missing
           FROM quota q LEFT JOIN classes c(e, class, cq) ON c.class = q.item_id
           GROUP BY item_id, quota HAVING count(c.class) < quota""",
    ),
    "relative_representation": (
        _RELATIVE,
        f"""SELECT purchase_event_id, event_number, conversation_ind, pos, {_r('value', 'value')}
            FROM relative WHERE purchase_event_id >= (SELECT id FROM cut)""",
    ),
    "relative_sequences": (
        _RELATIVE
        + """, rel_steps AS (
          SELECT DISTINCT purchase_event_id, event_number, conversation_id, session_id, conversation_ind
          FROM relative WHERE purchase_event_id < (SELECT id FROM cut)),
        rel_slots AS (
          SELECT *, count(*) OVER (PARTITION BY purchase_event_id) AS n_steps,
                 row_number() OVER (PARTITION BY purchase_event_id
                                    ORDER BY event_number NULLS LAST, conversation_id, session_id) AS position
          FROM rel_steps)""",
        f"""SELECT s.purchase_event_id, (SELECT max(n_steps) FROM rel_slots) - s.n_steps + s.position AS slot, s.n_steps,
                   s.conversation_ind, r.pos, {_r('r.value', 'value')}
            FROM rel_slots s JOIN relative r ON r.purchase_event_id = s.purchase_event_id
                 AND r.conversation_id IS NOT DISTINCT FROM s.conversation_id
                 AND r.session_id IS NOT DISTINCT FROM s.session_id""",
    ),
    "scorer_squares_conversation": (
        _SQUARES,
        f"""SELECT x.c AS row, y.c AS "column", {_r('sum(x.v * y.v)', 'value')}
            FROM xs x JOIN xs y USING (purchase_event_id) GROUP BY x.c, y.c""",
    ),
    "scorer_labels_conversation": (
        _SQUARES,
        f"""SELECT item_id, c AS row, {_r('sum(v)', 'value')} FROM xs JOIN train_labels USING (purchase_event_id) GROUP BY item_id, c""",
    ),
    "scorer_labels_session": (
        _ACTIONS
        + """, pooled AS (
          SELECT f.purchase_event_id, f.feature, max(CAST(f.slot = l.m AS DOUBLE)) AS last_step, sum(pow(0.5, l.m - f.slot)) AS recency
          FROM slot_features f JOIN longest l USING (is_train) WHERE f.is_train AND f.feature IS NOT NULL
          GROUP BY f.purchase_event_id, f.feature),
        each AS (
          SELECT purchase_event_id, feature, 'any_step' AS pooling, 1.0 AS v FROM pooled
          UNION ALL SELECT purchase_event_id, feature, 'last_step', last_step FROM pooled WHERE last_step > 0
          UNION ALL SELECT purchase_event_id, feature, 'recency', recency FROM pooled)""",
        f"""SELECT item_id, feature, pooling, {_r('sum(v)', 'value')} FROM each JOIN train_labels USING (purchase_event_id)
            GROUP BY item_id, feature, pooling""",
    ),
    "scorer_residuals_conversation": (
        _SQUARES,
        """SELECT item_id, c AS row, CAST(0 AS DOUBLE) AS residual
           FROM xs JOIN train_labels USING (purchase_event_id) GROUP BY item_id, c""",
    ),
    "encoder_squares_conversation": (
        _VECTORS
        + """, n AS (SELECT purchase_event_id, count(*) AS n FROM train_labels GROUP BY 1),
        talks AS (SELECT purchase_event_id, event_number, conversation_id FROM train WHERE conversation_id IS NOT NULL),
        xs AS (SELECT purchase_event_id, event_number, conversation_id, pos AS c, value AS v FROM conv_vec
               UNION ALL SELECT purchase_event_id, event_number, conversation_id, 64, 1.0 FROM talks),
        told AS (SELECT * FROM xs SEMI JOIN talks USING (purchase_event_id, event_number, conversation_id) JOIN n USING (purchase_event_id))""",
        f"""SELECT x.c AS row, y.c AS "column", {_r('sum(x.n * x.v * y.v)', 'value')}
            FROM told x JOIN told y USING (purchase_event_id, event_number, conversation_id) GROUP BY x.c, y.c""",
    ),
    "generated_steps": (
        _ACTIONS
        + """, class AS (
          SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS position
          FROM (SELECT DISTINCT feature FROM hot WHERE is_train AND feature IS NOT NULL)),
        lacking AS (SELECT purchase_event_id FROM test_types WHERE event = 'conversation'),
        told AS (
          SELECT purchase_event_id, age, feature FROM lacking, (SELECT unnest(range(4)) AS age) a, class
          WHERE position < 50 AND (purchase_event_id * 31 + age * 17 + position * 7) % 101 >= 50),
        numbered AS (
          SELECT purchase_event_id, age, row_number() OVER (PARTITION BY purchase_event_id ORDER BY age DESC) AS event_number
          FROM (SELECT DISTINCT purchase_event_id, age FROM told))""",
        """SELECT purchase_event_id, event_number, session_id, feature FROM hot WHERE NOT is_train
           UNION ALL
           SELECT t.purchase_event_id, n.event_number, NULL, t.feature FROM told t JOIN numbered n USING (purchase_event_id, age)""",
    ),
    "impute_conv_knn": (
        _ACTIONS
        + _VECTORS
        + _GENERATOR
        + """, lacking AS (SELECT purchase_event_id FROM test_types WHERE event = 'session'),
        test_hot AS (
          SELECT DISTINCT purchase_event_id, feature FROM tags SEMI JOIN lacking USING (purchase_event_id)
          JOIN pair_fit USING (feature) WHERE share >= 0.001),
        asked AS (
          SELECT l.purchase_event_id AS question,
                 CASE WHEN count(h.feature) > 0 THEN list(h.feature)
                      WHEN (SELECT count(*) FROM pair_empty) > 0 THEN [''] ELSE [] END AS a
          FROM lacking l LEFT JOIN test_hot h USING (purchase_event_id) GROUP BY 1),
        told AS (SELECT purchase_event_id, list(DISTINCT feature) AS b FROM pair_all
                 SEMI JOIN event_pos USING (purchase_event_id) GROUP BY 1),
        near AS (
          SELECT question, purchase_event_id, row_number() OVER (
                   PARTITION BY question
                   ORDER BY round(coalesce(len(list_intersect(a, b)) / sqrt(CAST(nullif(len(a) * len(b), 0) AS DOUBLE)), 0.0), 9) DESC,
                            purchase_event_id) AS r
          FROM asked, told)""",
        f"""SELECT question AS purchase_event_id, pos, {_r('avg(value)', 'value')}
            FROM near JOIN event_pos USING (purchase_event_id) WHERE r <= 5 GROUP BY question, pos""",
    ),
    "impute_ses_knn": (
        _ACTIONS
        + _VECTORS
        + _GENERATOR
        + """, lists AS (SELECT purchase_event_id, list(value ORDER BY pos) AS v FROM event_vec GROUP BY 1),
        near AS (
          SELECT q.purchase_event_id AS question, b.purchase_event_id, row_number() OVER (
                   PARTITION BY q.purchase_event_id ORDER BY round(list_cosine_similarity(q.v, b.v), 9) DESC, b.purchase_event_id) AS r
          FROM lists q SEMI JOIN (SELECT purchase_event_id FROM test_types WHERE event = 'conversation') t
               ON t.purchase_event_id = q.purchase_event_id, lists b
          WHERE b.purchase_event_id IN (SELECT purchase_event_id FROM both_ids)),
        two AS (SELECT *, count(*) OVER (PARTITION BY question) AS k FROM near WHERE r <= 2),
        shared AS (
          SELECT n.question, r.age, p.feature
          FROM two n JOIN recent r USING (purchase_event_id)
          JOIN pair_all p ON p.purchase_event_id = r.purchase_event_id AND p.session_id IS NOT DISTINCT FROM r.session_id
               AND p.event_number IS NOT DISTINCT FROM r.event_number
          GROUP BY n.question, r.age, p.feature, n.k HAVING 2 * count(*) >= n.k),
        numbered AS (
          SELECT question, age, row_number() OVER (PARTITION BY question ORDER BY age DESC) AS event_number
          FROM (SELECT DISTINCT question, age FROM shared))""",
        """SELECT question AS purchase_event_id, event_number, feature FROM shared JOIN numbered USING (question, age)""",
    ),
    "context_counts": (_CONTEXTS, "SELECT depth, context, item_id, n FROM context_k"),
    "context_shares": (
        _CONTEXTS
        + """, p0 AS (
          SELECT c.purchase_event_id, f.item_id, (coalesce(k.n, 0) + 0.5) / CAST(t.n + 1 AS DOUBLE) AS prior,
                 (coalesce(k.n, 0) + 0.5) / CAST(t.n + 1 AS DOUBLE) AS share
          FROM context c JOIN post_filter f USING (purchase_event_id) JOIN context_n t ON t.depth = 0
          LEFT JOIN context_k k ON k.depth = 0 AND k.item_id = f.item_id WHERE c.depth = 0 AND NOT c.is_train)"""
        + "".join(
            f""", p{d} AS (
          SELECT p.purchase_event_id, p.item_id, p.prior,
                 CASE WHEN t.n IS NULL THEN p.share ELSE (coalesce(k.n, 0) + 5 * p.share) / CAST(t.n + 5 AS DOUBLE) END AS share
          FROM p{d - 1} p LEFT JOIN context c ON c.purchase_event_id = p.purchase_event_id AND c.depth = {d}
          LEFT JOIN context_n t ON t.depth = {d} AND t.context = c.context
          LEFT JOIN context_k k ON k.depth = {d} AND k.context = c.context AND k.item_id = p.item_id)"""
            for d in (1, 2, 3)
        ),
        f"SELECT purchase_event_id, item_id, {_r('share', 'share')}, {_r('prior', 'prior')} FROM p3",
    ),
    "pooled_sessions": (
        _ACTIONS,
        f"""SELECT f.purchase_event_id, f.feature, CAST(1 AS DOUBLE) AS any_step,
                   max(CAST(f.slot = l.m AS DOUBLE)) AS last_step,
                   {_r('sum(pow(0.5, l.m - f.slot))', 'recency')}
            FROM slot_features f JOIN longest l USING (is_train) WHERE f.is_train AND f.feature IS NOT NULL
            GROUP BY f.purchase_event_id, f.feature""",
    ),
}


def oracle_sql() -> dict[str, str]:
    return {name: f"{_INPUT}{steps}\n{body}" for name, (steps, body) in _BODIES.items()}
