"""The projections of the given tables as DuckDB common table expressions, for the queries' SQL."""

CONV = """
c_turns AS (SELECT conv_id AS story_ord, 'conv_' || conv_id AS story, turn::INT AS idx, 'section_' || (turn + 1) AS section, 'event_' || turn AS event,
  'sentence_' || (turn + 1) AS sentence, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev,
  list_sort(list_distinct(list(role) OVER (PARTITION BY conv_id ORDER BY turn))) AS seen FROM conversations),
c_stories AS (SELECT DISTINCT story, story AS name, 'conversations' AS source_file, story_ord FROM c_turns),
c_sections AS (SELECT story, section, idx, 'Turn ' || (idx + 1) AS title, len(string_split_regex(text, '\\s+'))::INT AS word_count FROM c_turns),
c_sentences AS (SELECT story, sentence AS id, section, idx AS position, text FROM c_turns),
c_entities AS (SELECT DISTINCT story, role AS id, 'character' AS type, role AS label FROM c_turns),
c_events AS (SELECT story, event AS id, left(text, 60) AS label, section, idx AS ord, [sentence] AS source_nodes,
  CASE WHEN prev IS NULL OR prev = role THEN [role] ELSE [role, prev] END AS participants, [role] AS performs,
  role AS speaker, list_filter(seen, lambda x: x <> role) AS recipients, text AS content FROM c_turns),
c_part AS (SELECT story, id, unnest(participants) AS who, ord FROM c_events),
c_told AS (SELECT story, id, unnest(recipients) AS who, ord FROM c_events)
"""
MOVES = """
m_all AS (SELECT 'group_' || (user_id // 10) AS story, datediff('day', TIMESTAMP '2024-01-01', ts)::INT AS section_idx, 'user_' || user_id AS "from",
  CASE event_type WHEN 'purchase' THEN 'item_' || json_extract_string(props, '$.k') WHEN 'error' THEN 'box_' || json_extract_string(props, '$.k') ELSE 'place_' || event_type END AS "to",
  CASE event_type WHEN 'purchase' THEN 'OWNS' WHEN 'error' THEN 'IS_INSIDE' ELSE 'LOCATED_AT' END AS type,
  'event_' || lpad(event_id::VARCHAR, 8, '0') AS event, ts, event_id, event_type FROM events),
m_events AS (SELECT story, event AS id, event_type AS label, 'section_' || lpad((section_idx + 1)::VARCHAR, 2, '0') AS section, section_idx AS pos, ts, event_id FROM m_all),
m_edges AS (SELECT story, "from", "to", type, event AS valid_from, lead(event) OVER (PARTITION BY story, "from", type ORDER BY section_idx, ts, event_id) AS valid_until,
  section_idx, ts, event_id FROM m_all),
m_state AS (SELECT e.story, e."from" AS from_id, e."to" AS to_id, e.type AS rel_type, a.pos AS valid_from_section, b.pos AS valid_to_section
  FROM m_edges e JOIN m_events a ON a.story = e.story AND a.id = e.valid_from LEFT JOIN m_events b ON b.story = e.story AND b.id = e.valid_until),
m_entities AS (SELECT DISTINCT story, "from" AS id, 'character' AS type, replace("from", '_', ' ') AS label FROM m_all
  UNION SELECT DISTINCT story, "to", CASE type WHEN 'LOCATED_AT' THEN 'location' ELSE 'object' END, replace("to", '_', ' ') FROM m_all)
"""
TRADE = """
t_orders AS (SELECT n_name AS story, n_nationkey AS story_ord, o_orderkey, 'order_' || o_orderkey AS section, o_orderpriority AS title,
  (row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate, o_orderkey) - 1)::INT AS idx
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t_works AS (SELECT DISTINCT story, story_ord FROM t_orders),
t_sections AS (SELECT story, section, idx, title, length(title) % 7 + 1 AS word_count FROM t_orders),
t_lines AS (SELECT o.*, l_partkey, l_linenumber, l_quantity, l_returnflag, CASE WHEN story_ord % 2 = 1 THEN 'Mr Part ' ELSE 'Part-' END || l_partkey AS entity,
  'sentence_' || l_orderkey || '_' || l_linenumber AS sentence FROM lineitem JOIN t_orders o ON l_orderkey = o_orderkey),
t_labels AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'The ' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN string_split(p_name, ' ')[-1] ELSE p_name END AS label,
  CASE p_type WHEN 'MEDIUM' THEN 'character' WHEN 'STANDARD' THEN 'location' WHEN 'LARGE' THEN 'object' WHEN 'PROMO' THEN 'case' WHEN 'SMALL' THEN 'document' WHEN 'ECONOMY' THEN 'organisation' END AS type FROM part),
t_entities AS (SELECT DISTINCT story, story_ord, l_partkey AS ord, entity AS id, type, label FROM t_lines JOIN t_labels ON l_partkey = p_partkey),
t_mentions AS (SELECT story, story_ord, entity, section, idx, sum(l_quantity)::INT AS mention_count, list_sort(list_distinct(list(sentence))) AS sentence_ids FROM t_lines GROUP BY ALL),
t_sent0 AS (SELECT story, story_ord, section, idx, sentence AS id, l_linenumber, min(l_partkey) AS p, min(l_returnflag) AS f FROM t_lines GROUP BY ALL),
t_sentences AS (SELECT story, story_ord, id, section, (row_number() OVER (PARTITION BY story ORDER BY idx, l_linenumber) - 1)::INT AS position, p_name || ' ' || f AS text
  FROM t_sent0 JOIN part ON p = p_partkey),
t_events AS (SELECT story, 'event_' || o_orderkey AS id, section, min(title) AS label, list_sort(list_distinct(list(entity))) AS participants, list_sort(list_distinct(list(sentence))) AS source_nodes
  FROM t_lines GROUP BY story, o_orderkey, section),
t_keys AS (SELECT *, regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g') AS raw FROM t_entities),
t_canon AS (SELECT story, story_ord, ord, id, type, label, CASE WHEN type <> 'character' THEN type || ':' || raw ELSE regexp_replace(raw, '^mr_part_', 'part_') END AS key FROM t_keys),
t_ment AS (SELECT m.*, c.key, c.type, c.label FROM t_mentions m JOIN t_canon c ON c.story = m.story AND c.id = m.entity),
t_tot AS (SELECT key, sum(mention_count)::BIGINT AS total_mentions, count(DISTINCT story) AS n_works FROM t_ment GROUP BY key),
t_lab AS (SELECT key, arg_max(label, (length(label), -story_ord, -ord)) AS best, arg_min(type, (story_ord, ord)) AS type, min(story_ord) AS so, arg_min(ord, (story_ord, ord)) AS eo FROM t_canon GROUP BY key),
t_sum AS (SELECT key, array_to_string(list_transform(string_split(best, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label, type,
  coalesce(total_mentions, 0)::BIGINT AS total_mentions, coalesce(n_works, 0)::BIGINT AS n_works FROM t_lab LEFT JOIN t_tot USING (key))
"""
DOCS = """
d_raw AS (SELECT 'doc_' || doc_id AS story, source AS work, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
d_para0 AS (SELECT story, unnest(list_filter(list_transform(string_split_regex(text, '\\n{2,}'), lambda p: trim(regexp_replace(p, '[\\s\\x0b]+', ' ', 'g'))), lambda p: p <> '')) AS text,
  generate_subscripts(list_filter(list_transform(string_split_regex(text, '\\n{2,}'), lambda p: trim(regexp_replace(p, '[\\s\\x0b]+', ' ', 'g'))), lambda p: p <> ''), 1) - 1 AS ord FROM d_raw)
"""
#: Sentences of a text p, given a relation d_in(story, ord, p); initials with inner full stops don't occur in the tables.
SENTENCES = r"""
d_mask AS (SELECT *, regexp_replace(p, '\b(Mr|Mrs|Ms|Dr|St|Jr|Sr|vs|etc|Prof|Capt)\.', '\1' || chr(1), 'g') AS masked FROM d_in),
d_found AS (SELECT *, list_filter(list_transform(regexp_extract_all(masked, '([^.!?\n]+[.!?]+(?:["”’)]+)?)(?:\s+|$)', 1), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '') AS found,
  trim(replace(masked, chr(1), '.')) AS rest FROM d_mask),
d_tail AS (SELECT *, trim(substr(rest, length(array_to_string(found, ' ')) + 1)) AS tail FROM d_found),
d_sent AS (SELECT story, ord, CASE WHEN rest <> '' AND tail <> '' THEN list_append(found, tail) ELSE found END AS s FROM d_tail)
"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + " "
