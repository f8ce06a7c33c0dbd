"""Queries over the graph build, perspectives and states, and their SQL."""


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.operators import graph as G
from storygraph.operators import objective as O
from storygraph.operators import perspective as P
from storygraph.plans.sql import CONV, MOVES, TRADE, with_
from storygraph.sources.projections import conversations, moves, trade


def _conv(spark: SparkSession, d: str) -> tuple[dict, DataFrame, DataFrame]:
    c = conversations(spark, d)
    return c, G.nodes(c["stories"], c["sections"], c["sentences"], c["entities"], c["events"]), G.event_edges(c["events"])


def _moves(spark: SparkSession, d: str) -> tuple[dict, DataFrame, DataFrame]:
    m = moves(spark, d)
    stories = m["entities"].select("story", F.col("story").alias("name"), F.lit("moves").alias("source_file")).distinct()
    none = m["sections"].select("story", F.col("section").alias("id"), "section", F.col("idx").alias("position"), F.lit("").alias("text")).limit(0)
    events = G.event_positions(m["events"], m["sections"])
    return m, G.nodes(stories, m["sections"], none, m["entities"], m["events"]), G.windowed_edges(O.state_windows(m["state_changes"]), events)


def _trade_mentions(spark: SparkSession, d: str) -> tuple[dict, DataFrame]:
    t = trade(spark, d)
    return t, G.mention_edges(t["mentions"], t["sections"])


def nodes(spark, d):
    return _conv(spark, d)[1].select("story", "kind", "id", "subkind", "name", "pos")


def node_props(spark, d):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return _conv(spark, d)[1].select("story", "kind", "id", get("sourceFile").alias("source_file"), get("wordCount").alias("word_count"), get("section").alias("section"), get("speakerId").alias("speaker"))


def event_edges(spark, d):
    return _conv(spark, d)[2].select("story", "from_id", "to_id", "rel_type", "valid_from_section", "valid_to_section")


def state_edges(spark, d):
    return _moves(spark, d)[2].select("story", "from_id", "to_id", "rel_type", "valid_from_section", "valid_to_section")


def mention_edges(spark, d):
    return _trade_mentions(spark, d)[1].select("story", "from_id", "to_id", "rel_type", "valid_from_section")


def _some_missing(n: DataFrame) -> DataFrame:
    """Without one role of every third story, so that there are edges to drop."""
    return n.filter(~((F.col("kind") == "entity") & (F.col("id") == "user") & (F.length("story") % 2 == 0)))


def checked_edges(spark, d):
    _, n, e = _conv(spark, d)
    return G.checked_edges(e, _some_missing(n))[0].select("story", "from_id", "to_id", "rel_type")


def dropped_counts(spark, d):
    _, n, e = _conv(spark, d)
    return G.dropped_counts(e, _some_missing(n))


def graph_totals(spark, d):
    _, n, e = _conv(spark, d)
    return G.totals(n, e)


def key_violations(spark, d):
    _, n, e = _conv(spark, d)
    return G.key_violations(n, e.unionByName(e.filter("to_id = 'event_1'").withColumn("to_id", F.lit("event_x"))))


def skipped_entities(spark, d):
    e = trade(spark, d)["entities"]
    return G.skipped_entities(e.withColumn("type", F.when(F.col("ord") % 10 == 0, "thing").otherwise(F.col("type"))))


def knowledge_cube(spark, d):
    _, n, e = _conv(spark, d)
    return P.knowledge(P.facts(n, e), P.all_keys(n)).select("story", "character", "section", "event", "modality", "id", "description", "confidence")


def knowledge_facts(spark, d):
    _, n, e = _conv(spark, d)
    return P.facts(n, e).select("story", "character", "event", "pos", "modality", "description")


def event_shapes(spark, d):
    _, n, e = _conv(spark, d)
    return P.events(n, e).select("story", "id", "label", "pos", "participants", "performs", F.col("communicates.speaker").alias("speaker"), F.col("communicates.recipients").alias("recipients"))


def entity_shapes(spark, d):
    return P.entities(_conv(spark, d)[1]).select("story", "id", "type", "label", "description")


def _keys(c: dict, n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each role at its story's last section, and a key of an unknown role and section for each story."""
    last = c["sections"].groupBy("story").agg(F.max_by("section", "idx").alias("section"))
    keys = c["entities"].select("story", F.col("id").alias("character")).join(last, "story")
    odd = last.select("story", F.lit("nobody").alias("character"), "section").unionByName(last.select("story", F.lit("user").alias("character"), F.lit("section_x").alias("section")))
    return P.resolved_keys(keys.unionByName(odd), n)


def context(spark, d):
    c, n, e = _conv(spark, d)
    k = _keys(c, n)[0].select("story", "character", "section", "cutoff")
    return P.knowledge(P.facts(n, e), k).groupBy("story", "character", "section").agg(F.count(F.lit(1)).alias("known"), F.sum((F.col("modality") == "TOLD").cast("int")).alias("told"))


def context_problems(spark, d):
    c, n, _ = _conv(spark, d)
    return _keys(c, n)[1]


def visible_events(spark, d):
    c, n, _ = _conv(spark, d)
    return P.visible_events(n, c["sections"].select("story", "section", F.col("idx").alias("cutoff"))).select("story", "section", "event", "label")


def document_knowledge(spark, d):
    c = conversations(spark, d)
    keys = c["entities"].select("story", F.col("id").alias("character")).join(c["sections"].select("story", "section"), "story")
    events = c["events"].withColumn("section", F.when(F.col("ord") % 4 == 3, "nowhere").otherwise(F.col("section")))
    return P.document_knowledge(events, c["sections"], keys).select("story", "character", "section", "id", "modality", "description")


def knows_via(spark, d):
    _, n, e = _conv(spark, d)
    return P.knows_via(n, e).select("story", "character", "event", "name", "pos", "knows_via")


def met_so_far(spark, d):
    return P.met_so_far(_conv(spark, d)[1], 2)


def listed_stories(spark, d):
    c, n, _ = _conv(spark, d)
    return P.listed_stories(n, c["stories"].select("story", (-F.col("story_ord")).alias("ord")))


def numbered_states(spark, d):
    return P.numbered_states(_moves(spark, d)[2])


def payload_mentions(spark, d):
    t, e = _trade_mentions(spark, d)
    n = t["sections"].select("story", F.lit("section").alias("kind"), F.col("section").alias("id"), F.col("idx").alias("pos"))
    return P.payload_mentions(e, n)


def state_windows(spark, d):
    return O.state_windows(moves(spark, d)["state_changes"]).select("story", "id", "from", "to", "type", "valid_from", "valid_until")


def state_at(spark, d):
    m, n, e = _moves(spark, d)
    keys = m["entities"].filter("type = 'character'").select("story", F.col("id").alias("entity"), F.explode(F.array(*[F.lit(x) for x in (0, 7, 14, 29)])).alias("n"))
    return P.state_at(e, n, keys)


def present(spark, d):
    c = conversations(spark, d)
    return P.present(c["events"], c["entities"])


def readable(spark, d):
    c = conversations(spark, d)
    return P.readable(c["stories"], c["sentences"].filter("position >= 4")).select("story", "name")


def prompts(spark, d):
    c, n, e = _conv(spark, d)
    out = P.prompts(_keys(c, n)[0], P.facts(n, e), n)
    return out.select("story", "character", "section", *[F.md5(x).alias(x) for x in ("witnessed", "observed", "told")])


def dossier(spark, d):
    m, _, e = _moves(spark, d)
    events = G.event_positions(m["events"], m["sections"]).select("story", "id", "pos", "participants", F.array().cast("array<string>").alias("recipients"))
    keys = m["entities"].select("story", F.col("id").alias("entity"), F.lit(5).alias("n"))
    none = lambda s: spark.createDataFrame([], s)
    return P.dossier(keys, events, e, none("story string, entity string, section string, idx int"), none("story string, object string, case string, discovered_by string, idx int"), none("story string, character string, organisation string, valid_from_section int"))


def subgraph(spark, d):
    c = conversations(spark, d)
    events = c["events"].withColumn("pos", F.col("ord"))
    states = c["entities"].alias("a").join(c["entities"].alias("b"), "story").filter("a.id < b.id").select("story", F.col("a.id").alias("from_id"), F.col("b.id").alias("to_id"))
    return P.subgraph(c["sections"].select("story", "section", F.col("idx").alias("cutoff")), events, states).distinct()


QUERIES = {
    "graph_nodes": nodes, "graph_node_props": node_props, "graph_event_edges": event_edges, "graph_state_edges": state_edges, "graph_mention_edges": mention_edges,
    "graph_checked_edges": checked_edges, "graph_dropped_counts": dropped_counts, "graph_totals": graph_totals, "graph_key_violations": key_violations, "graph_skipped_entities": skipped_entities,
    "perspective_knowledge_cube": knowledge_cube, "perspective_facts": knowledge_facts, "perspective_events": event_shapes, "perspective_entities": entity_shapes,
    "perspective_context": context, "perspective_context_problems": context_problems, "perspective_visible_events": visible_events, "perspective_documents": document_knowledge,
    "perspective_knows_via": knows_via, "perspective_met_so_far": met_so_far, "perspective_listed_stories": listed_stories, "perspective_numbered_states": numbered_states,
    "perspective_mentions": payload_mentions, "perspective_state_at": state_at, "perspective_present": present, "perspective_readable": readable, "perspective_prompts": prompts,
    "perspective_dossier": dossier, "perspective_subgraph": subgraph, "objective_state_windows": state_windows,
}

_NODES = """, n AS (SELECT story, 'story' AS kind, story AS id, NULL AS subkind, name, NULL::INT AS pos FROM c_stories
UNION ALL SELECT story, 'section', section, NULL, title, idx FROM c_sections UNION ALL SELECT story, 'lexical', id, NULL, NULL, position FROM c_sentences
UNION ALL SELECT story, 'entity', id, type, label, NULL FROM c_entities UNION ALL SELECT story, 'event', id, NULL, label, ord FROM c_events) """
_EDGES = """, e AS (SELECT story, who AS from_id, id AS to_id, 'PARTICIPATED_IN' AS rel_type FROM c_part UNION ALL SELECT story, speaker, id, 'PERFORMED' FROM c_events
UNION ALL SELECT story, speaker, id, 'SPOKE_IN' FROM c_events UNION ALL SELECT story, id, who, 'TOLD_TO' FROM c_told) """
_FACTS = """, f AS (SELECT c_part.story, who AS character, c_part.id AS event, c_part.ord AS pos, 'OBSERVED' AS modality, label AS description FROM c_part JOIN c_events USING (story, id)
UNION ALL SELECT c_told.story, who, c_told.id, c_told.ord, 'TOLD', content FROM c_told JOIN c_events USING (story, id)) """
_LAST = ", k AS (SELECT e.story, e.id AS character, s.section, s.idx AS cutoff FROM c_entities e JOIN (SELECT story, arg_max(section, idx) AS section, max(idx) AS idx FROM c_sections GROUP BY story) s USING (story)) "
_DROP = ", x AS (SELECT *, (from_id = 'user' OR to_id = 'user') AND length(story) % 2 = 0 AS gone FROM e) "
C, M, T = with_(CONV), with_(MOVES), with_(TRADE)
ORACLES = {
    "graph_nodes": C + _NODES + "SELECT * FROM n",
    "graph_node_props": C + """SELECT story, 'story' AS kind, story AS id, source_file, NULL AS word_count, NULL AS section, NULL AS speaker FROM c_stories
UNION ALL SELECT story, 'section', section, NULL, word_count::VARCHAR, NULL, NULL FROM c_sections UNION ALL SELECT story, 'lexical', id, NULL, NULL, section, NULL FROM c_sentences
UNION ALL SELECT story, 'entity', id, NULL, NULL, NULL, NULL FROM c_entities UNION ALL SELECT story, 'event', id, NULL, NULL, section, speaker FROM c_events""",
    "graph_event_edges": C + _EDGES + "SELECT *, NULL::INT AS valid_from_section, NULL::INT AS valid_to_section FROM e",
    "graph_state_edges": M + "SELECT * FROM m_state",
    "graph_mention_edges": T + "SELECT story, entity AS from_id, section AS to_id, 'MENTIONED_IN' AS rel_type, idx AS valid_from_section FROM t_mentions",
    "graph_checked_edges": C + _EDGES + _DROP + "SELECT story, from_id, to_id, rel_type FROM x WHERE NOT gone",
    "graph_dropped_counts": C + _EDGES + _DROP + "SELECT story, rel_type, count(*) AS dropped FROM x WHERE gone GROUP BY story, rel_type",
    "graph_totals": C + _NODES + _EDGES + ", a AS (SELECT story, count(*) AS nodes FROM n GROUP BY ROLLUP (story)), b AS (SELECT story, count(*) AS edges FROM e GROUP BY ROLLUP (story)) SELECT a.story, nodes, coalesce(edges, 0) AS edges FROM a LEFT JOIN b ON a.story IS NOT DISTINCT FROM b.story",
    "graph_key_violations": C + "SELECT DISTINCT 'missing end' AS problem, story, 'event_x' AS id FROM c_events WHERE id = 'event_1'",
    "graph_skipped_entities": T + "SELECT story, id, 'thing' AS type, label FROM t_entities WHERE ord % 10 = 0",
    "perspective_knowledge_cube": C + _FACTS + """SELECT f.story, character, s.section, event, modality, CASE modality WHEN 'OBSERVED' THEN 'obs_' ELSE 'belief_' END || event || '_' || character AS id, description,
CASE modality WHEN 'OBSERVED' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM f JOIN c_sections s ON s.story = f.story AND pos <= s.idx""",
    "perspective_facts": C + _FACTS + "SELECT * FROM f",
    "perspective_events": C + "SELECT story, id, label, ord AS pos, list_sort(participants) AS participants, performs, CASE WHEN content <> '' THEN speaker END AS speaker, CASE WHEN content <> '' THEN list_sort(recipients) END AS recipients FROM c_events",
    "perspective_entities": C + "SELECT story, id, type, label, NULL AS description FROM c_entities",
    "perspective_context": C + _FACTS + _LAST + "SELECT story, character, section, count(*) AS known, count(*) FILTER (modality = 'TOLD') AS told FROM k JOIN f USING (story, character) WHERE pos <= cutoff GROUP BY ALL",
    "perspective_context_problems": C + _LAST + "SELECT DISTINCT story, 'nobody' AS character, section, 'unknown character' AS problem FROM k UNION ALL SELECT DISTINCT story, 'user', 'section_x', 'unknown section' FROM k",
    "perspective_visible_events": C + "SELECT s.story, s.section, e.id AS event, label FROM c_sections s JOIN c_events e ON e.story = s.story AND e.ord <= s.idx",
    "perspective_documents": C + """, f AS (SELECT story, id, who AS character, 'OBSERVED' AS modality, label AS description, ord FROM c_part JOIN (SELECT story, id, label FROM c_events) USING (story, id)
UNION ALL SELECT story, id, who, 'TOLD', content, ord FROM c_told JOIN (SELECT story, id, content FROM c_events) USING (story, id))
SELECT s.story, character, section, id, modality, description FROM f JOIN c_sections s ON s.story = f.story AND CASE WHEN ord % 4 = 3 THEN -1 ELSE ord END <= s.idx""",
    "perspective_knows_via": C + _EDGES + """SELECT e.story, CASE rel_type WHEN 'TOLD_TO' THEN to_id ELSE from_id END AS character, v.id AS event, v.label AS name, v.ord AS pos, rel_type AS knows_via
FROM e JOIN c_events v ON v.story = e.story AND v.id = CASE rel_type WHEN 'TOLD_TO' THEN from_id ELSE to_id END""",
    "perspective_met_so_far": C + _NODES + "SELECT story, kind, id, name, pos FROM n WHERE kind IN ('entity', 'event') AND (pos IS NULL OR pos <= 2)",
    "perspective_listed_stories": C + "SELECT story, name, -story_ord AS ord FROM c_stories",
    "perspective_numbered_states": M + "SELECT story, 'state_' || (row_number() OVER (PARTITION BY story ORDER BY from_id, to_id, rel_type, valid_from_section, valid_to_section NULLS FIRST) - 1) AS id, from_id, to_id, rel_type, valid_from_section, valid_to_section FROM m_state",
    "perspective_mentions": T + "SELECT story, entity, section, idx AS pos, mention_count, sentence_ids FROM t_mentions",
    "perspective_state_at": M + """SELECT s.story, s.from_id AS entity, n::INT AS n, rel_type, to_id AS target_id, replace(to_id, '_', ' ') AS target_label FROM m_state s, unnest([0, 7, 14, 29]) AS u(n)
WHERE valid_from_section <= n AND (valid_to_section IS NULL OR valid_to_section > n)""",
    "perspective_present": C + "SELECT story, section, participants AS characters FROM c_events",
    "perspective_readable": C + "SELECT DISTINCT story, story AS name FROM c_sentences WHERE position >= 4",
    "perspective_prompts": C + _FACTS + _LAST + """, o AS (SELECT k.story, k.character, k.section, string_agg('  - [' || event || '] ' || description, chr(10) ORDER BY pos, event) FILTER (modality = 'OBSERVED') AS w,
string_agg('  - ' || description || ' [event ' || event || ']', chr(10) ORDER BY pos, event) FILTER (modality = 'OBSERVED') AS o,
string_agg('  - "' || description || '" (told via event ' || event || ')', chr(10) ORDER BY pos, event) FILTER (modality = 'TOLD') AS t
FROM k LEFT JOIN f ON f.story = k.story AND f.character = k.character AND pos <= cutoff GROUP BY ALL)
SELECT story, character, section, md5(coalesce(w, '  (none)')) AS witnessed, md5(coalesce(o, '  (none)')) AS observed, md5(coalesce(t, '  (none)')) AS told FROM o""",
    "perspective_dossier": M + """, p AS (SELECT story, "from" AS entity, section_idx AS pos, event AS ref, 'event' AS facet FROM m_all
UNION ALL SELECT story, from_id, valid_from_section, from_id || ' ' || rel_type || ' ' || to_id, 'state from' FROM m_state UNION ALL SELECT story, to_id, valid_from_section, from_id || ' ' || rel_type || ' ' || to_id, 'state to' FROM m_state)
SELECT story, entity, 5 AS n, facet, ref FROM p WHERE pos <= 5""",
    "perspective_subgraph": C + """, w AS (SELECT s.story, s.section, s.idx, p.who, p.id FROM c_sections s JOIN c_part p ON p.story = s.story AND p.ord <= s.idx)
SELECT DISTINCT a.story, a.section, 'state' AS kind, a.who AS source, b.who AS target FROM w a JOIN w b ON a.story = b.story AND a.section = b.section AND a.who < b.who
UNION SELECT story, section, 'participation', who, id FROM w UNION SELECT s.story, s.section, 'comm', v.speaker, t.who FROM c_sections s JOIN c_told t ON t.story = s.story AND t.ord <= s.idx JOIN c_events v ON v.story = t.story AND v.id = t.id""",
    "objective_state_windows": M + """, g AS (SELECT *, first_value(struct_pack(a := section_idx, b := ts, c := event_id)) OVER (PARTITION BY story, "from", type ORDER BY section_idx, ts, event_id) AS first FROM m_edges)
SELECT story, 'state_' || row_number() OVER (PARTITION BY story ORDER BY first, section_idx, ts, event_id) AS id, "from", "to", type, valid_from, valid_until FROM g""",
}
