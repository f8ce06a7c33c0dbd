"""Queries over extraction, the timeline and verification, and their SQL."""

from pyspark.sql import functions as F

from storygraph.operators import extraction as E
from storygraph.operators import graph as G
from storygraph.operators import objective as O
from storygraph.operators import perspective as P
from storygraph.operators import quality as K
from storygraph.operators import timeline as TL
from storygraph.plans.sql import CONV, MOVES, TRADE, with_
from storygraph.sources import io
from storygraph.sources.projections import conversations, moves, table, trade


def answers(spark, d):
    """An answer for each turn, fenced for every third turn and cut short for every 50th conversation's first."""
    c = conversations(spark, d)
    sid = F.col("source_nodes")
    role, other = F.col("performs")[0], F.coalesce(F.get("communicates.recipients", F.lit(0)), F.lit(""))
    blob = F.struct(
        F.array(F.struct(role.alias("id"), F.lit("").alias("type"), F.lit("x").alias("client"), role.alias("label"))).alias("newEntities"),
        F.array(F.struct("id", "label", sid.alias("source_nodes"), "participants", F.struct(role.alias("speaker"), F.col("communicates.recipients").alias("recipients"), F.substring("label", 1, 5).alias("content")).alias("communicates"))).alias("events"),
        F.array(F.struct(role.alias("from"), F.concat(F.lit("location_"), F.col("ord").cast("string")).alias("to"), F.lit("LOCATED_AT").alias("type"), F.col("id").alias("caused_by_event"))).alias("stateChanges"),
        F.array(F.struct(F.concat(F.lit("object_"), role).alias("entity"), sid.alias("sentence_ids"))).alias("mentions"),
        F.when(F.col("ord") % 2 == 0, F.array(F.struct(F.lit("object_key").alias("object"), F.lit("case_one").alias("case"), other.alias("discovered_by"), F.lit("s").alias("significance"), sid.alias("source_nodes")))).alias("clues"),
        F.array(F.struct(role.alias("character"), F.lit("organisation_talk").alias("organisation"), F.col("id").alias("valid_from"))).alias("memberOf"),
    )
    raw = F.to_json(blob)
    cut = F.regexp_extract("story", "[0-9]+", 0).cast("int") % 50 == 0
    raw = F.when(cut & (F.col("ord") == 0), F.expr("'{\"newEntities\": ['")).when(F.col("ord") % 3 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise(raw)
    return E.parsed(c["events"].select("story", "section", F.col("ord").alias("section_idx"), raw.alias("raw")))


def payloads(spark, d):
    c = conversations(spark, d)
    first = c["events"].select("story", F.col("performs")[0].alias("id"), "ord").groupBy("story", "id").agg(F.min("ord").alias("first_idx"))
    e = c["entities"].join(first, ["story", "id"])
    return E.payloads(c["sentences"], c["sections"], e).select("story", "section", F.md5("lexical_text").alias("body"), "known_list")


def parse_flags(spark, d):
    return answers(spark, d).groupBy("parse_ok").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("p.events")).alias("events"))


def new_entities(spark, d):
    return E.new_entities(answers(spark, d)).select("story", "section", "id", "type", "label", "description", "client")


def parsed_events(spark, d):
    return E.events(answers(spark, d)).select("story", "section", "id", "label", "source_nodes", "participants", F.col("communicates.content").alias("content"), F.coalesce(F.size("performs"), F.lit(-1)).alias("performs"))


def parsed_mentions(spark, d):
    return E.mentions(answers(spark, d)).select("story", "section", "entity", "mention_count", "sentence_ids")


def parsed_clues(spark, d):
    return E.clues(answers(spark, d)).select("story", "object", "case", "discovered_by", "discovered_in_section", "source_nodes")


def registry(spark, d):
    a = answers(spark, d)
    return O.registry(E.new_entities(a), E.clues(a), E.members(a), E.mentions(a))


def healed(spark, d):
    a = answers(spark, d)
    return O.healed(E.mentions(a), E.new_entities(a).select("story", "id", "type", "label").distinct())


def memberships(spark, d):
    return O.memberships(E.members(answers(spark, d))).select("story", "character", "organisation", "valid_from")


def parsed_states(spark, d):
    return O.state_windows(E.state_changes(answers(spark, d))).select("story", "id", "from", "to", "valid_from", "valid_until")


def section_stats(spark, d):
    return E.section_stats(answers(spark, d))


def ingest_totals(spark, d):
    return E.ingest_totals(answers(spark, d))


def forbidden_terms(spark, d):
    c = conversations(spark, d)
    return E.forbidden([c["events"].select("story", "label"), c["entities"]], ["system", "The ", "zzzz"])


def unsourced(spark, d):
    a = answers(spark, d)
    s = O.state_windows(E.state_changes(a)).withColumn("valid_from", F.when(F.col("id") != "state_1", F.col("valid_from")))
    e = E.events(a).withColumn("source_nodes", F.when(F.col("section_idx") != 1, F.col("source_nodes")))
    return E.unsourced(s, e, E.clues(a))


def bad_references(spark, d):
    a = answers(spark, d)
    return E.bad_references(E.new_entities(a), E.clues(a), E.members(a), E.mentions(a))


def _tl(spark, d):
    c = conversations(spark, d)
    r = TL.section_ranges(c["sections"], c["sentences"])
    return c, r, TL.event_positions(c["events"], c["sentences"], r)


def section_ranges(spark, d):
    t = trade(spark, d)
    return TL.section_ranges(t["sections"], t["sentences"])


def _heads(sentences):
    return sentences.groupBy("story").agg(F.floor(F.max("position") / 2).cast("int").alias("p"))


def current_section(spark, d):
    t = trade(spark, d)
    heads = _heads(t["sentences"])
    return TL.current_section(heads.unionByName(heads.withColumn("p", F.lit(10**8))), TL.section_ranges(t["sections"], t["sentences"]))


def event_positions(spark, d):
    c, r, _ = _tl(spark, d)
    e = c["events"].withColumn("source_nodes", F.when(F.col("ord") % 3 == 1, F.array(F.lit("none"))).otherwise(F.col("source_nodes"))).withColumn("section", F.when(F.col("ord") % 6 == 4, "nowhere").otherwise(F.col("section")))
    return TL.event_positions(e, c["sentences"], r)


def mention_positions(spark, d):
    t = trade(spark, d)
    return TL.mention_positions(t["mentions"], t["sentences"], TL.section_ranges(t["sections"], t["sentences"]))


def entity_positions(spark, d):
    c, r, pos = _tl(spark, d)
    return TL.entity_positions(c["events"], pos, TL.mention_positions(E.mentions(answers(spark, d)), c["sentences"], r))


def whole_dossier(spark, d):
    """All facets of all entities of the conversations and their answers, half-way through each story."""
    c, a = conversations(spark, d), answers(spark, d)
    ids = c["entities"].select("story", F.explode(F.array("id", F.concat(F.lit("object_"), "id"))).alias("entity"))
    fixed = c["stories"].select("story", F.explode(F.array(*map(F.lit, ("object_key", "case_one", "organisation_talk", "location_0")))).alias("entity"))
    keys = ids.unionByName(fixed).join(_heads(c["sentences"]).withColumnRenamed("p", "n"), "story")
    idx = c["sections"].select("story", "section", "idx")
    at = G.event_positions(c["events"], c["sections"])
    events = at.select("story", "id", "pos", "participants", F.col("communicates.recipients").alias("recipients"))
    states = G.windowed_edges(O.state_windows(E.state_changes(a)), at)
    mentions = E.mentions(a).select("story", "entity", "section").join(idx, ["story", "section"], "left")
    clues = E.clues(a).select("story", "object", "case", "discovered_by", F.col("discovered_in_section").alias("section")).join(idx, ["story", "section"], "left")
    begin = at.select("story", F.col("id").alias("valid_from"), F.col("pos").alias("valid_from_section"))
    members = O.memberships(E.members(a)).select("story", "character", "organisation", "valid_from").join(begin, ["story", "valid_from"], "left")
    return P.dossier(keys, events, states, mentions, clues, members)


def _seen(spark, d, character: bool):
    c, r, pos = _tl(spark, d)
    heads = _heads(c["sentences"])
    if character:
        heads = heads.withColumn("character", F.lit("assistant"))
    none = c["sections"].select("story", F.lit("").alias("entity"), "section", F.lit(0).alias("pos")).limit(0)
    epos = TL.entity_positions(c["events"], pos, none)
    events = TL.visible_events(heads, c["events"], pos)
    return c, r, pos, heads, events, TL.visible_entities(heads, c["entities"], epos, events), epos


def timeline_events(spark, d):
    return _seen(spark, d, False)[4].select("story", "p", "id")


def timeline_character_events(spark, d):
    return _seen(spark, d, True)[4].select("story", "p", "id")


def timeline_mentions(spark, d):
    t = trade(spark, d)
    r = TL.section_ranges(t["sections"], t["sentences"])
    heads = F.broadcast(_heads(t["sentences"]))  # a row for each nation
    out = TL.mentions_reached(heads, TL.mention_positions(t["mentions"], t["sentences"], r), F.broadcast(TL.current_section(heads, r)))
    return out.select("story", "p", "entity", F.size("sections").alias("n"), "here")


def timeline_entities(spark, d):
    return _seen(spark, d, True)[5].select("story", "p", "id", "pos")


def _states(c):
    e = c["events"].select("story", F.col("performs")[0].alias("from"), F.col("participants")[F.size("participants") - 1].alias("to"), F.col("id").alias("valid_from"), F.col("ord"))
    return e.select("story", "from", "to", F.lit("LOCATED_AT").alias("type"), "valid_from", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("event_"), (F.col("ord") + 1).cast("string"))).alias("valid_until"))


def timeline_states(spark, d):
    c, _, pos, heads, _, seen, _ = _seen(spark, d, False)
    return TL.active_edges(heads, _states(c), pos, seen).select("story", "p", "from", "to", "valid_from", "active")


def timeline_clues(spark, d):
    c, r, _, heads, _, seen, _ = _seen(spark, d, False)
    clues = c["events"].filter("size(participants) = 2").select("story", F.col("participants")[0].alias("object"), F.col("participants")[1].alias("case"), F.col("section").alias("discovered_in_section"), "source_nodes")
    return TL.visible_clues(heads, clues, c["sentences"], r, seen)


def timeline_entering(spark, d):
    return TL.entering(_seen(spark, d, False)[6])


def timeline_section_events(spark, d):
    m = moves(spark, d)
    return TL.section_event_counts(m["sections"], m["events"].filter("label = 'purchase' AND section > 'section_05'"))


def timeline_snapshot(spark, d):
    c, _, pos, heads, events, seen, _ = _seen(spark, d, False)
    return TL.snapshot(events, seen, TL.active_edges(heads, _states(c), pos, seen))


def _graph(spark, d):
    c = conversations(spark, d)
    return c, G.nodes(c["stories"], c["sections"], c["sentences"], c["entities"], c["events"]), G.event_edges(c["events"])


def counts(spark, d):
    _, n, e = _graph(spark, d)
    return K.counts(n, e)


def checked_counts(spark, d):
    c, n, e = _graph(spark, d)
    expected = c["sections"].agg(F.count(F.lit(1)).alias("expected")).select(F.lit("kind").alias("level"), F.lit("section").alias("name"), "expected")
    return K.checked(K.counts(n, e), expected)


def _broken(spark, d):
    c, n, e = _graph(spark, d)
    more = e.filter("to_id = 'event_0' AND rel_type = 'PERFORMED'")
    return c, n, e.unionByName(more.withColumn("to_id", F.lit("event_x"))).unionByName(more.withColumn("to_id", F.col("from_id")))


def orphan_edges(spark, d):
    _, n, e = _broken(spark, d)
    return K.orphan_edges(e, n).select("story", "from_id", "to_id", "rel_type")


def self_edges(spark, d):
    return K.self_edges(_broken(spark, d)[2]).select("story", "from_id", "rel_type")


def stray_nodes(spark, d):
    c, n, _ = _graph(spark, d)
    return K.stray_nodes(n, c["stories"].filter("story_ord % 2 = 0")).select("story", "kind", "id")


def unreachable(spark, d):
    _, n, e = _graph(spark, d)
    return K.unreachable(n, e.filter("rel_type = 'TOLD_TO'")).select("story", "kind", "id")


def story_count(spark, d):
    return K.story_count(_graph(spark, d)[1])


def digest_sizes(spark, d):
    t = trade(spark, d)
    a = K.digests(t["entities"].select("story", "id", "type", "label"), ["story"])
    b = K.digests(t["entities"].select("story", "label", "id", "type").repartition(7), ["story"])
    return a.join(b.select("story", F.col("hash").alias("_h")), "story").select("story", "size", (F.col("hash") == F.col("_h")).alias("same"))


def manifest_mismatches(spark, d):
    e = trade(spark, d)["entities"].select("story", "id", "type", "label")
    other = e.withColumn("label", F.when((F.col("story") == "NATION_3") & (F.col("id").rlike("7$")), "x").otherwise(F.col("label"))).filter("story != 'NATION_4'")
    return K.manifest_mismatches(K.digests(e, ["story"]), K.digests(other, ["story"]), ["story"]).select("story", F.col("right").isNull().alias("missing"))


def order_violations(spark, d):
    s = moves(spark, d)
    e = G.event_positions(s["events"], s["sections"]).withColumn("pos", F.when(F.col("id").endswith("77"), 100).otherwise(F.col("pos")))
    return K.order_violations(e, "ord", "pos").select("story", "id")


def first_difference(spark, d):
    s = trade(spark, d)["sentences"].select("story", "position", "text")
    other = s.withColumn("text", F.when(F.col("position") == 11, "x").otherwise(F.col("text"))).filter("position < 500")
    return K.first_difference(s, other, ["position"])


def _runs(spark, d):
    c = conversations(spark, d)
    run = lambda df: df.withColumn("run", F.when(F.regexp_extract("story", "[0-9]+", 0).cast("int") % 2 == 0, "even").otherwise("odd"))
    return {k: run(v) for k, v in c.items()}


def run_metrics(spark, d):
    r = _runs(spark, d)
    tables = {"sections": r["sections"], "entities": r["entities"], "events": r["events"], "speech": r["events"]}
    return K.run_metrics(tables, {"speech": F.size("communicates.recipients") > 0})


def bad_citations(spark, d):
    r = _runs(spark, d)
    cited = r["events"].select("run", "story", F.concat("source_nodes", F.when(F.col("ord") == 2, F.array(F.lit("sentence_x"))).otherwise(F.array().cast("array<string>"))).alias("ids"))
    return K.bad_citations(cited, r["sentences"])


def type_histogram(spark, d):
    e = trade(spark, d)["entities"].withColumn("run", F.col("story"))
    return K.type_histogram(e, ["character", "case"])


def case_ids(spark, d):
    return K.case_ids(trade(spark, d)["entities"].withColumn("run", F.concat(F.lit("run_"), (F.col("story_ord") % 3).cast("string"))))


def labelled_runs(spark, d):
    """Documents by group of their label."""
    story = lambda df: df.withColumn("story", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    groups = story(table(spark, d, "labels")).select("story", F.when(F.col("quality") == 0, "bad").otherwise("good").alias("group"))
    return io.in_group(story(table(spark, d, "documents")), groups, "bad").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def todo(spark, d):
    """Conversations not done, and sections with sentences that aren't completed."""
    c = conversations(spark, d)
    done = c["stories"].filter("story_ord % 3 = 0").select("story")
    completed = c["sections"].filter("idx < 2").select("story", "section")
    return io.pending_sections(io.pending_stories(c["sections"], done), c["sentences"], completed).select("story", "section", "idx")


QUERIES = {
    "extract_payloads": payloads, "extract_parse_flags": parse_flags, "extract_new_entities": new_entities, "extract_events": parsed_events, "extract_mentions": parsed_mentions, "extract_clues": parsed_clues,
    "extract_registry": registry, "extract_healed": healed, "extract_memberships": memberships, "extract_states": parsed_states, "extract_section_stats": section_stats, "extract_ingest_totals": ingest_totals,
    "validate_forbidden": forbidden_terms, "validate_unsourced": unsourced, "validate_references": bad_references,
    "timeline_section_ranges": section_ranges, "timeline_current_section": current_section, "timeline_event_positions": event_positions, "timeline_mention_positions": mention_positions,
    "timeline_entity_positions": entity_positions, "perspective_whole_dossier": whole_dossier, "timeline_events": timeline_events, "timeline_character_events": timeline_character_events, "timeline_mentions": timeline_mentions,
    "timeline_entities": timeline_entities, "timeline_states": timeline_states, "timeline_clues": timeline_clues, "timeline_entering": timeline_entering, "timeline_section_events": timeline_section_events,
    "timeline_snapshot": timeline_snapshot, "quality_counts": counts, "quality_checked_counts": checked_counts, "quality_orphan_edges": orphan_edges, "quality_self_edges": self_edges,
    "quality_stray_nodes": stray_nodes, "quality_unreachable": unreachable, "quality_story_count": story_count, "quality_digests": digest_sizes, "quality_mismatches": manifest_mismatches,
    "quality_order": order_violations, "quality_first_difference": first_difference, "quality_run_metrics": run_metrics, "quality_bad_citations": bad_citations, "quality_type_histogram": type_histogram,
    "quality_case_ids": case_ids, "source_groups": labelled_runs, "source_todo": todo,
}

C, M, T = with_(CONV), with_(MOVES), with_(TRADE)
_OK = ", ok AS (SELECT v.*, t.story_ord FROM c_events v JOIN c_stories t USING (story) WHERE NOT (story_ord % 50 = 0 AND ord = 0)) "
_RNG = ", cnt AS (SELECT story, section, count(*) AS count FROM t_sentences GROUP BY 1, 2), rng AS (SELECT s.story, s.section, idx, coalesce(count, 0)::BIGINT AS count, (coalesce(sum(coalesce(count, 0)) OVER (PARTITION BY s.story ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM t_sections s LEFT JOIN cnt USING (story, section)) "
_HEAD = ", h AS (SELECT story, (max(position) // 2)::INT AS p FROM {} GROUP BY story) "
_MP = ", mp0 AS (SELECT story, entity, section, unnest(sentence_ids) AS id FROM t_mentions), mp AS (SELECT m.story, entity, m.section, min(position) AS pos FROM mp0 m JOIN t_sentences s ON s.story = m.story AND s.id = m.id GROUP BY 1, 2, 3) "
_EP = ", ep AS (SELECT story, who AS id, min(ord) AS pos FROM (SELECT * FROM c_part UNION ALL SELECT * FROM c_told) GROUP BY 1, 2) "
_SEEN = _HEAD.format("c_sentences") + _EP + ", sn AS (SELECT h.story, p, id, pos FROM h JOIN ep USING (story) WHERE pos <= p) "
_STATE = ", st AS (SELECT story, speaker AS \"from\", participants[-1] AS \"to\", id AS valid_from, ord, CASE WHEN ord % 2 = 0 THEN ord + 1 END AS until FROM c_events), sv AS (SELECT st.story, p, \"from\", \"to\", valid_from, NOT (until IS NOT NULL AND until <= p AND until IN (SELECT e.ord FROM c_events e WHERE e.story = st.story)) AS active FROM st JOIN h USING (story) WHERE st.ord <= p) "
_N = """, n AS (SELECT 'story' AS kind, NULL AS subkind, story, story AS id FROM c_stories UNION ALL SELECT 'section', NULL, story, section FROM c_sections UNION ALL SELECT 'lexical', NULL, story, id FROM c_sentences
UNION ALL SELECT 'entity', type, story, id FROM c_entities UNION ALL SELECT 'event', NULL, story, id FROM c_events), e AS (SELECT story, who AS from_id, id AS to_id, 'PARTICIPATED_IN' AS rel_type FROM c_part UNION ALL SELECT story, speaker, id, 'PERFORMED' FROM c_events
UNION ALL SELECT story, speaker, id, 'SPOKE_IN' FROM c_events UNION ALL SELECT story, id, who, 'TOLD_TO' FROM c_told),
ct AS (SELECT 'nodes' AS level, 'all' AS name, count(*) AS n FROM n UNION ALL SELECT 'kind', kind, count(*) FROM n GROUP BY kind UNION ALL SELECT 'subkind', kind || '/' || subkind, count(*) FROM n WHERE subkind IS NOT NULL GROUP BY kind, subkind
UNION ALL SELECT 'edges', 'all', count(*) FROM e UNION ALL SELECT 'rel_type', rel_type, count(*) FROM e GROUP BY rel_type) """
_RUN = "CASE WHEN regexp_extract(story, '[0-9]+')::INT % 2 = 0 THEN 'even' ELSE 'odd' END"
ORACLES = {
    "extract_payloads": C + """, fe AS (SELECT story, speaker AS id, min(ord) AS f FROM c_events GROUP BY 1, 2), k AS (SELECT s.story, s.section, string_agg('- ' || id || ' (character): ' || id, chr(10) ORDER BY f, id) AS known FROM c_sections s JOIN fe ON fe.story = s.story AND f < s.idx GROUP BY 1, 2)
SELECT c.story, c.section, md5('[' || id || '] ' || text) AS body, coalesce(known, '(none yet)') AS known_list FROM c_sentences c LEFT JOIN k USING (story, section)""",
    "extract_parse_flags": C + "SELECT NOT (story_ord % 50 = 0 AND ord = 0) AS parse_ok, count(*) AS n, sum((NOT (story_ord % 50 = 0 AND ord = 0))::INT)::BIGINT AS events FROM c_events JOIN c_stories USING (story) GROUP BY 1",
    "extract_new_entities": C + _OK + "SELECT story, section, speaker AS id, 'object' AS type, speaker AS label, '' AS description, NULL AS client FROM ok",
    "extract_events": C + _OK + "SELECT story, section, id, label, source_nodes, participants, left(label, 5) AS content, -1 AS performs FROM ok",
    "extract_mentions": C + _OK + "SELECT story, section, 'object_' || speaker AS entity, 1 AS mention_count, source_nodes AS sentence_ids FROM ok",
    "extract_clues": C + _OK + "SELECT story, 'object_key' AS object, 'case_one' AS case, coalesce(list_sort(recipients)[1], '') AS discovered_by, section AS discovered_in_section, source_nodes FROM ok WHERE ord % 2 = 0",
    "extract_registry": C + _OK + """, r AS (SELECT story, ord, 0 AS prio, speaker AS id, 'object' AS type, speaker AS label FROM ok UNION ALL SELECT story, ord, 1, 'case_one', 'case', 'case one' FROM ok WHERE ord % 2 = 0 UNION ALL SELECT story, ord, 2, 'object_key', 'object', 'object key' FROM ok WHERE ord % 2 = 0
UNION ALL SELECT story, ord, 3, list_sort(recipients)[1], 'character', list_sort(recipients)[1] FROM ok WHERE ord % 2 = 0 AND len(recipients) > 0 UNION ALL SELECT story, ord, 4, speaker, 'character', speaker FROM ok
UNION ALL SELECT story, ord, 5, 'organisation_talk', 'organisation', 'organisation talk' FROM ok UNION ALL SELECT story, ord, 6, 'object_' || speaker, 'object', 'object ' || speaker FROM ok),
q AS (SELECT *, row_number() OVER (PARTITION BY story, id ORDER BY ord, prio) AS rn FROM r) SELECT story, id, type, label, ord AS first_idx, prio > 0 AS stub FROM q WHERE rn = 1""",
    "extract_healed": C + _OK + "SELECT DISTINCT story, speaker AS id, 'object' AS type, speaker AS label FROM ok UNION SELECT DISTINCT story, 'object_' || speaker, 'object', speaker FROM ok",
    "extract_memberships": C + _OK + "SELECT story, speaker AS character, 'organisation_talk' AS organisation, arg_min(id, ord) AS valid_from FROM ok GROUP BY 1, 2",
    "extract_states": C + _OK + """, g AS (SELECT *, min(ord) OVER (PARTITION BY story, speaker) AS f FROM ok) SELECT story, 'state_' || row_number() OVER (PARTITION BY story ORDER BY f, ord) AS id, speaker AS "from", 'location_' || ord AS "to", id AS valid_from, lead(id) OVER (PARTITION BY story, speaker ORDER BY ord) AS valid_until FROM g""",
    "extract_section_stats": C + ", o AS (SELECT v.*, (NOT (story_ord % 50 = 0 AND ord = 0))::INT AS k FROM c_events v JOIN c_stories USING (story)) SELECT story, section, ord AS section_idx, k AS entities, k AS events, k AS states, (sum(k) OVER w)::BIGINT AS total_entities, (sum(k) OVER w)::BIGINT AS total_events, (sum(k) OVER w)::BIGINT AS total_states FROM o WINDOW w AS (PARTITION BY story ORDER BY ord)",
    "extract_ingest_totals": C + _OK + "SELECT (SELECT count(*) FROM c_events) AS sections, count(*) AS entities, count(*) AS events, count(*) AS states, count(*) AS mentions, count(*) FILTER (ord % 2 = 0) AS clues FROM ok",
    "validate_forbidden": C + "SELECT DISTINCT story, term FROM (SELECT story, label FROM c_events UNION ALL SELECT story, id || label FROM c_entities), (SELECT unnest(['system', 'The ', 'zzzz']) AS term) WHERE contains(label, term)",
    "validate_unsourced": C + _OK + "SELECT DISTINCT story, 'state without valid_from' AS problem, 'state_1' AS id FROM ok UNION ALL SELECT story, 'event without source', id FROM ok WHERE ord = 1",
    "validate_references": C + _OK + """SELECT DISTINCT story, 'clue of no case' AS problem, 'case_one' AS id FROM ok WHERE ord % 2 = 0 UNION SELECT story, 'clue of no object', 'object_key' FROM ok WHERE ord % 2 = 0
UNION SELECT story, 'clue of no finder', list_sort(recipients)[1] AS f FROM ok WHERE ord % 2 = 0 AND len(recipients) > 0 AND (story, list_sort(recipients)[1]) NOT IN (SELECT (story, speaker) FROM ok)
UNION SELECT story, 'member of no organisation', 'organisation_talk' FROM ok UNION SELECT story, 'mention of none', 'object_' || speaker FROM ok""",
    "timeline_section_ranges": T + _RNG + "SELECT * FROM rng",
    "timeline_current_section": T + _RNG + _HEAD.format("t_sentences") + """, hh AS (SELECT * FROM h UNION ALL SELECT story, 100000000 FROM h), a AS (SELECT hh.story, p, section, idx, row_number() OVER (PARTITION BY hh.story, p ORDER BY p < start + count DESC, CASE WHEN p < start + count THEN idx ELSE -idx END) AS rn FROM hh JOIN rng USING (story))
SELECT story, p, section, idx FROM a WHERE rn = 1""",
    "timeline_event_positions": C + "SELECT story, id, CASE WHEN ord % 6 = 4 THEN 0 ELSE ord END::BIGINT AS pos FROM c_events",
    "timeline_mention_positions": T + _MP + "SELECT story, entity, section, pos::BIGINT AS pos FROM mp",
    "timeline_entity_positions": C + _OK + "SELECT story, who AS id, min(ord)::BIGINT AS pos FROM (SELECT story, who, ord FROM c_part UNION ALL SELECT story, who, ord FROM c_told UNION ALL SELECT story, 'object_' || speaker, ord FROM ok) GROUP BY 1, 2",
    "perspective_whole_dossier": C + _OK + _HEAD.format("c_sentences") + """, k AS (SELECT story, entity, p AS n FROM h JOIN (SELECT story, id AS entity FROM c_entities UNION ALL SELECT story, 'object_' || id FROM c_entities
UNION ALL SELECT story, unnest(['object_key', 'case_one', 'organisation_talk', 'location_0']) FROM c_stories) USING (story)),
mb AS (SELECT story, speaker, min(ord) AS pos FROM ok GROUP BY 1, 2), ck AS (SELECT story, ord AS pos, coalesce(list_sort(recipients)[1], '') AS who FROM ok WHERE ord % 2 = 0),
f AS (SELECT story, who AS entity, ord AS pos, id AS ref, 'event' AS facet FROM (SELECT story, who, ord, id FROM c_part UNION SELECT story, who, ord, id FROM c_told)
UNION ALL SELECT story, speaker, ord, speaker || ' LOCATED_AT location_' || ord, 'state from' FROM ok UNION ALL SELECT story, 'location_' || ord, ord, speaker || ' LOCATED_AT location_' || ord, 'state to' FROM ok
UNION ALL SELECT story, 'object_' || speaker, ord, section, 'mention' FROM ok
UNION ALL SELECT story, 'case_one', pos, 'object_key', 'clue case' FROM ck UNION ALL SELECT story, 'object_key', pos, 'object_key', 'clue object' FROM ck UNION ALL SELECT story, who, pos, 'object_key', 'clue discovered_by' FROM ck
UNION ALL SELECT story, speaker, pos, speaker || ' in organisation_talk', 'member character' FROM mb UNION ALL SELECT story, 'organisation_talk', pos, speaker || ' in organisation_talk', 'member organisation' FROM mb)
SELECT story, entity, n, facet, ref FROM k JOIN f USING (story, entity) WHERE pos <= n""",
    "timeline_events": C + _HEAD.format("c_sentences") + "SELECT h.story, p, id FROM h JOIN c_events USING (story) WHERE ord <= p",
    "timeline_character_events": C + _HEAD.format("c_sentences") + "SELECT h.story, p, id FROM h JOIN c_events USING (story) WHERE ord <= p AND (list_contains(participants, 'assistant') OR list_contains(recipients, 'assistant'))",
    "timeline_mentions": T + _MP + _RNG + _HEAD.format("t_sentences") + ", cs AS (SELECT h.story, p, arg_min(section, idx) AS here FROM h JOIN rng USING (story) WHERE p < start + count GROUP BY 1, 2) SELECT cs.story, p, entity, count(*)::INT AS n, bool_or(section = here) AS here FROM cs JOIN mp USING (story) WHERE pos <= p GROUP BY 1, 2, 3",
    "timeline_entities": C + _SEEN + ", sc AS (SELECT h.story, unnest(participants) AS id FROM h JOIN c_events USING (story) WHERE ord <= p AND (list_contains(participants, 'assistant') OR list_contains(recipients, 'assistant')) UNION SELECT story, 'assistant' FROM h) SELECT sn.story, p, sn.id, pos::BIGINT AS pos FROM sn JOIN sc USING (story, id)",
    "timeline_states": C + _SEEN + _STATE + "SELECT * FROM sv",
    "timeline_clues": C + _SEEN + "SELECT DISTINCT v.story, p, participants[1] AS object, participants[2] AS case, ord::BIGINT AS pos FROM c_events v JOIN h USING (story) WHERE ord <= p AND len(participants) = 2",
    "timeline_entering": C + _EP + "SELECT story, pos::BIGINT AS pos, count(*) AS entering FROM ep GROUP BY 1, 2",
    "timeline_section_events": M + ", s AS (SELECT DISTINCT story, section_idx AS idx FROM m_all), n AS (SELECT story, pos AS idx, count(*) AS events FROM m_events WHERE label = 'purchase' AND section > 'section_05' GROUP BY 1, 2) SELECT story, 'section_' || lpad((idx + 1)::VARCHAR, 2, '0') AS section, idx, coalesce(events, 0)::BIGINT AS events FROM s LEFT JOIN n USING (story, idx)",
    "timeline_snapshot": C + _SEEN + _STATE + """, ev AS (SELECT h.story, p, v.* EXCLUDE (story) FROM h JOIN c_events v USING (story) WHERE ord <= p), pt AS (SELECT story, p, id, speaker, unnest(participants) AS who FROM ev), tl AS (SELECT story, p, speaker, left(content, 60) AS label, unnest(recipients) AS who FROM ev)
SELECT story, p, 'state' AS kind, "from" AS source, "to" AS target, 'LOCATED_AT' AS label, active FROM sv UNION ALL SELECT story, p, 'participation', who, id, CASE WHEN who = speaker THEN 'performs' ELSE 'witness' END, true FROM pt UNION ALL SELECT story, p, 'communicates', speaker, who, label, true FROM tl""",
    "quality_counts": C + _N + "SELECT * FROM ct",
    "quality_checked_counts": C + _N + "SELECT level, name, n, CASE WHEN level = 'kind' AND name = 'section' THEN n ELSE 0 END::BIGINT AS expected, CASE WHEN level = 'kind' AND name = 'section' THEN 0 ELSE n END::BIGINT AS delta, level = 'kind' AND name = 'section' AS passed FROM ct",
    "quality_orphan_edges": C + "SELECT story, speaker AS from_id, 'event_x' AS to_id, 'PERFORMED' AS rel_type FROM c_events WHERE id = 'event_0'",
    "quality_self_edges": C + "SELECT story, speaker AS from_id, 'PERFORMED' AS rel_type FROM c_events WHERE id = 'event_0'",
    "quality_stray_nodes": C + _N + "SELECT n.story, kind, id FROM n JOIN c_stories USING (story) WHERE story_ord % 2 <> 0",
    "quality_unreachable": C + _N + ", t AS (SELECT story, id FROM c_told UNION SELECT story, who FROM c_told) SELECT story, kind, id FROM n WHERE kind IN ('entity', 'event') AND (story, id) NOT IN (SELECT (story, id) FROM t)",
    "quality_story_count": C + "SELECT count(*) AS stories FROM c_stories",
    "quality_digests": T + "SELECT story, count(*) AS size, true AS same FROM t_entities GROUP BY 1",
    "quality_mismatches": T + "SELECT DISTINCT story, story = 'NATION_4' AS missing FROM t_entities WHERE story = 'NATION_4' OR (story = 'NATION_3' AND id LIKE '%7')",
    "quality_order": M + ", p AS (SELECT *, CASE WHEN id LIKE '%77' THEN 100 ELSE pos END AS q FROM m_events), l AS (SELECT *, lag(q) OVER (PARTITION BY story ORDER BY ts, event_id) AS b FROM p) SELECT story, id FROM l WHERE b > q",
    "quality_first_difference": T + "SELECT story, 11 AS first, count(*) AS left_size, count(*) FILTER (position < 500) AS right_size FROM t_sentences GROUP BY 1",
    "quality_run_metrics": C + f", m AS (SELECT 'sections' AS metric, {_RUN} AS run, 1 AS k FROM c_sections UNION ALL SELECT 'entities', {_RUN}, 1 FROM c_entities UNION ALL SELECT 'events', {_RUN}, 1 FROM c_events UNION ALL SELECT 'speech', {_RUN}, (len(recipients) > 0)::INT FROM c_events) SELECT metric, sum(k) FILTER (run = 'even')::BIGINT AS even, sum(k) FILTER (run = 'odd')::BIGINT AS odd FROM m GROUP BY 1",
    "quality_bad_citations": C + f"SELECT {_RUN} AS run, count(*) + count(*) FILTER (ord = 2) AS total, count(*) FILTER (ord = 2) AS bad FROM c_events GROUP BY 1",
    "quality_type_histogram": T + "SELECT story AS run, count(*) FILTER (type = 'character') AS character, count(*) FILTER (type = 'case') AS case FROM t_entities GROUP BY 1",
    "quality_case_ids": T + "SELECT 'run_' || (story_ord % 3) AS run, list_sort(list(DISTINCT id)) AS ids FROM t_entities WHERE type = 'case' GROUP BY 1",
    "source_groups": "SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY lang",
    "source_todo": C + "SELECT s.story, section, idx FROM c_sections s JOIN c_stories t USING (story) WHERE story_ord % 3 <> 0 AND idx >= 2",
}
