"""Queries over corpus analytics and reconciliation, and their SQL."""

from pyspark.sql import functions as F

from storygraph.operators import analytics as A
from storygraph.operators import clusters as CL
from storygraph.operators import objective as O
from storygraph.operators import reconcile as R
from storygraph.plans.source_plans import _folder
from storygraph.plans.sql import CONV, MOVES, TRADE, with_
from storygraph.sources.io import keeper
from storygraph.sources.projections import aliases, conversations, moves, table, trade

PHRASES = ["red", "small ring", "widget", "green", "zzz"]


def _t(spark, d):
    t = trade(spark, d)
    t["keyed"] = A.with_key(t["entities"], aliases(spark, d))
    t["km"] = A.keyed_mentions(t["mentions"], t["keyed"])
    t["sum"] = A.entity_summaries(t["keyed"], t["km"])
    return t


def canonical_keys(spark, d):
    return _t(spark, d)["keyed"].select("story", "id", "type", "key")


def pretty_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", A.X.pretty_label(F.col("p_name")).alias("label"))


def _works(spark, d):
    t = _t(spark, d)
    return t, A.work_summaries(t["works"], t["sections"], t["sentences"], t["entities"], t["mentions"], t["events"])


def work_summaries(spark, d):
    return _works(spark, d)[1].drop("story_ord")


def entity_summaries(spark, d):
    return _t(spark, d)["sum"].select("key", "label", "type", "total_mentions", F.size("works").cast("long").alias("n_works"))


def raw_ids(spark, d):
    return A.raw_ids(_t(spark, d)["keyed"])


def presence(spark, d):
    t = _t(spark, d)
    return A.presence(t["km"], t["sentences"]).select("key", "story", "id", F.round("fraction", 6).alias("fraction"), "position")


def searchable(spark, d):
    return A.searchable(trade(spark, d)["sentences"], 12).select("story", "id", "position", F.round("fraction", 6).alias("fraction"))


def search(spark, d):
    return A.search(trade(spark, d)["sentences"], " Small ring").select("story", "id", "position", "text")


def scoreboard(spark, d):
    return A.scoreboard(trade(spark, d)["sentences"], PHRASES)


def co_occurrence(spark, d):
    t = _t(spark, d)
    return A.co_occurrence(t["km"], t["sum"])


def network(spark, d):
    t = _t(spark, d)
    return A.network(A.co_occurrence(t["km"], t["sum"]), t["sum"], 2)[1]


def _segments(spark, d):
    m = moves(spark, d)
    return A.trajectories(m["events"], m["entities"], O.state_windows(m["state_changes"]))


def trajectories(spark, d):
    return _segments(spark, d)


def tracks(spark, d):
    return A.tracks(_segments(spark, d), ["user_8", "user_46"]).select("story", "character", "segments", "rank")


def frequency(spark, d):
    return A.frequency(_t(spark, d)["sum"]).select("type_ord", "type", "rank", "key", "count", "works", "type_total")


def presence_payload(spark, d):
    t = _t(spark, d)
    top = A.top_keys(t["sum"].filter("total_mentions >= 2"), "character", 60)  # chosen before their mentions meet the sentences
    return A.presence_payload(A.presence(t["km"].join(F.broadcast(top), "key", "left_semi"), t["sentences"]), t["sum"])


def presence_totals(spark, d):
    t = _t(spark, d)
    return A.presence_totals(A.presence(t["km"], t["sentences"]))


def long_tail(spark, d):
    return A.long_tail(_t(spark, d)["sum"])


def tail_summary(spark, d):
    return A.tail_summary(A.long_tail(_t(spark, d)["sum"])).select("type", "total", "n", F.round("top10_share", 8).alias("top10_share"), "few", F.round("few_share", 8).alias("few_share"))


def density(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return A.density(_works(spark, d)[1]).select("story", r("entity_density"), r("event_density"), r("mention_density"), "stack", "largest")


def funnel(spark, d):
    t, w = _works(spark, d)
    return A.funnel(w, A.frequency(t["sum"]))


def naming(spark, d):
    t = trade(spark, d)
    return A.naming(t["mentions"], t["sentences"], "^(Mr )?Part.1[0-9]$")


def appearances(spark, d):
    return A.appearances(trade(spark, d)["mentions"], "^(Mr )?Part.1[0-9]$")


def shared_sections(spark, d):
    return A.shared_sections(trade(spark, d)["mentions"], "1$", "2$")


def of_section(spark, d):
    t = trade(spark, d)
    return A.of_section(t["mentions"], t["entities"], t["sections"])


def variants(spark, d):
    return A.variants(trade(spark, d)["entities"], "Part.1[0-9]$")


def _passage(spark, d):
    t = trade(spark, d)
    spans = t["works"].select("story", F.lit(10).alias("i"), F.lit(30).alias("j"))
    return A.passage(t["sentences"], t["mentions"], t["events"], spans)


def passage_sentences(spark, d):
    return _passage(spark, d)["sentences"].select("story", "id", "position", "entities")


def passage_events(spark, d):
    return _passage(spark, d)["events"].select("story", "event", F.array_sort("source_nodes").alias("source_nodes"))


def passage_entities(spark, d):
    return _passage(spark, d)["entities"]


def labelled_clues(spark, d):
    c = conversations(spark, d)
    clues = c["events"].select("story", "ord", F.col("performs")[0].alias("object"), F.lit("case_x").alias("case"), F.get("communicates.recipients", F.lit(0)).alias("discovered_by"), F.array(F.col("source_nodes")[0], F.lit("sentence_x")).alias("source_nodes"))
    clues = clues.withColumn("discovered_by", F.coalesce("discovered_by", F.lit("none")))
    entities = c["entities"].withColumn("label", F.concat(F.lit("The "), "label"))
    return A.labelled_clues(clues, entities, c["sentences"]).select("story", "ord", "object_label", "case_label", "discovered_by_label", F.size("texts").alias("n"), F.md5(F.array_join("texts", "")).alias("body"))


def tagged(spark, d):
    t = trade(spark, d)
    m = t["mentions"].select("story", "entity", F.explode("sentence_ids").alias("id"))
    labels = m.join(t["entities"].select("story", F.col("id").alias("entity"), "ord", "type", "label"), ["story", "entity"])
    return A.tagged(t["sentences"], labels).select("story", "id", F.size("segments").alias("n"), F.array_join(F.transform("segments", lambda x: F.concat(x["text"], F.lit("<"), F.coalesce(x["entity"], F.lit("")), F.lit(">"))), "").alias("spans"))


def citations(spark, d):
    t = trade(spark, d)
    return A.citations(t["events"], t["mentions"])


def _canon(spark, d):
    e = trade(spark, d)["entities"]
    return e, R.canonical(e)


def canonical_entities(spark, d):
    return _canon(spark, d)[1]


def normalised_candidates(spark, d):
    return R.normalised_candidates(*_canon(spark, d))


def alias_clusters(spark, d):
    """H9 closed: every name of every story with its cluster; the aliases of the characters are the seeds."""
    n = CL.names(trade(spark, d)["entities"])
    keep = keeper(spark, _folder(spark))
    n = keep(n)
    return CL.clusters(n, CL.links(n, aliases(spark, d).select(F.col("key").alias("a"), F.col("canonical").alias("b"))), keep)


def suffix_candidates(spark, d):
    return R.suffix_candidates(_canon(spark, d)[1])


def split_counts(spark, d):
    return R.split_counts(_canon(spark, d)[1])


def cross_references(spark, d):
    t = trade(spark, d)
    return R.cross_references(t["mentions"], t["entities"]).select("entity", "label", "refs", "source", "section", "mention_count")


def nested_references(spark, d):
    t = trade(spark, d)
    return R.nested_references(R.cross_references(t["mentions"], t["entities"])).select("entity", "label", F.size("refs").alias("n"), F.md5(F.array_join(F.transform("refs", lambda r: F.concat_ws(" ", r["source"], r["section"])), ",")).alias("body"))


def cases(spark, d):
    t = trade(spark, d)
    clues = t["entities"].filter("type = 'case' AND ord % 2 = 0").select("story", F.col("id").alias("case"), F.concat(F.lit("o_"), "id").alias("object"), F.col("story").alias("discovered_by"), F.lit("s").alias("significance"))
    return R.cases(t["entities"], clues).select("story", "id", "label", F.size("clues").alias("n"), F.get("clues", F.lit(0))["object"].alias("object"))


def document_catalogue(spark, d):
    return R.document_catalogue(trade(spark, d)["entities"])


def _variants(spark, d):
    t = trade(spark, d)
    return A.raw_variants(t["entities"], t["mentions"])


def merge_clusters(spark, d):
    groups = aliases(spark, d)
    groups = groups.select(F.col("key").alias("raw"), F.col("canonical").alias("cluster")).unionByName(groups.select(F.col("canonical").alias("raw"), F.col("canonical").alias("cluster")))
    return R.merge_clusters(_variants(spark, d), groups)


def collision_buckets(spark, d):
    return R.collision_buckets(_variants(spark, d), "(?i)ring", "the")


QUERIES = {
    "analytics_canonical_keys": canonical_keys, "analytics_pretty_labels": pretty_labels, "analytics_work_summaries": work_summaries, "analytics_entity_summaries": entity_summaries, "analytics_raw_ids": raw_ids,
    "analytics_presence": presence, "analytics_searchable": searchable, "analytics_search": search, "analytics_scoreboard": scoreboard, "analytics_co_occurrence": co_occurrence, "analytics_network": network,
    "analytics_trajectories": trajectories, "analytics_tracks": tracks, "analytics_frequency": frequency, "analytics_presence_payload": presence_payload, "analytics_presence_totals": presence_totals,
    "analytics_long_tail": long_tail, "analytics_tail_summary": tail_summary, "analytics_density": density, "analytics_funnel": funnel, "analytics_naming": naming, "analytics_appearances": appearances,
    "analytics_shared_sections": shared_sections, "analytics_of_section": of_section, "analytics_variants": variants, "analytics_passage_sentences": passage_sentences, "analytics_passage_events": passage_events,
    "analytics_passage_entities": passage_entities, "analytics_labelled_clues": labelled_clues, "analytics_tagged": tagged, "analytics_citations": citations,
    "reconcile_canonical": canonical_entities, "reconcile_normalised": normalised_candidates, "reconcile_suffixes": suffix_candidates, "reconcile_split_counts": split_counts,
    "reconcile_cross_references": cross_references, "reconcile_nested_references": nested_references, "reconcile_cases": cases, "reconcile_documents": document_catalogue,
    "reconcile_alias_clusters": alias_clusters, "reconcile_merge_clusters": merge_clusters, "reconcile_collisions": collision_buckets,
}

T, M, C = with_(TRADE), with_(MOVES), with_(CONV)
_WORKS = """, w AS (SELECT story, section_count, word_count, sentence_count, entity_count, mention_count, event_count FROM (SELECT story, count(*) AS section_count, sum(word_count)::BIGINT AS word_count FROM t_sections GROUP BY 1)
LEFT JOIN (SELECT story, count(*) AS sentence_count FROM t_sentences GROUP BY 1) USING (story) LEFT JOIN (SELECT story, count(*) AS entity_count FROM t_entities GROUP BY 1) USING (story)
LEFT JOIN (SELECT story, sum(mention_count)::BIGINT AS mention_count FROM t_mentions GROUP BY 1) USING (story) LEFT JOIN (SELECT story, count(*) AS event_count FROM t_events GROUP BY 1) USING (story)) """
_SEEN = ", t_s AS (SELECT s.*, so, eo FROM t_sum s JOIN t_lab USING (key)) "
_TOP = _SEEN + ", top AS (SELECT key FROM t_s WHERE type = 'character' ORDER BY total_mentions DESC, so, eo LIMIT 40) "
_CO = _TOP + ", own AS (SELECT DISTINCT story, section, key FROM t_ment WHERE key IN (SELECT key FROM top)), co AS (SELECT a.key AS a, b.key AS b, count(*) AS weight FROM own a JOIN own b ON a.story = b.story AND a.section = b.section AND a.key < b.key GROUP BY 1, 2) "
_FRAC = ", n AS (SELECT story, count(*) AS n FROM t_sentences GROUP BY 1), fr AS (SELECT s.*, CASE WHEN n > 1 THEN position / (n - 1) ELSE 0 END AS fraction FROM t_sentences s JOIN n USING (story)) "
_PRES = _FRAC + ", cited AS (SELECT key, story, unnest(sentence_ids) AS id FROM t_ment), pres AS (SELECT key, story, id, fraction, position, text FROM cited JOIN fr USING (story, id)) "
_TAIL = _SEEN + ", r0 AS (SELECT 'all' AS type, key, total_mentions, so, eo FROM t_s WHERE total_mentions > 0 UNION ALL SELECT type, key, total_mentions, so, eo FROM t_s WHERE total_mentions > 0), r AS (SELECT type, key, total_mentions AS count, (row_number() OVER (PARTITION BY type ORDER BY total_mentions DESC, so, eo))::INT AS rank FROM r0) "
_FREQ = _SEEN + """, q AS (SELECT *, (row_number() OVER (PARTITION BY type ORDER BY total_mentions DESC, so, eo))::INT AS rank FROM t_s),
fq AS (SELECT (list_position(['character', 'location', 'object', 'organisation', 'document', 'case'], type) - 1)::INT AS type_ord, type, rank, key, total_mentions AS count, n_works::INT AS works, (sum(total_mentions) OVER (PARTITION BY type))::BIGINT AS type_total FROM q WHERE rank <= 60) """
_SEG = """, ix AS (SELECT story, id, row_number() OVER (PARTITION BY story ORDER BY section, id) - 1 AS i FROM m_events), al AS (SELECT story, count(*) AS n FROM m_events GROUP BY 1),
seg AS (SELECT e.story, "from" AS character, upper(left("from", 1)) || substr(split_part("from", '_', 1), 2) || ' ' || split_part("from", '_', 2) AS label, "to" AS location, a.i AS start, greatest(coalesce(b.i, al.n), a.i + 1) AS stop
FROM m_edges e JOIN al USING (story) JOIN ix a ON a.story = e.story AND a.id = valid_from LEFT JOIN ix b ON b.story = e.story AND b.id = valid_until WHERE type = 'LOCATED_AT') """
_H = r"""regexp_replace({}, '^(mr\.?\s*|mrs\.?\s*|ms\.?\s*|dr\.?\s*|sir\s+|lady\s+|lord\s+|professor\s+|inspector\s+|sergeant\s+|captain\s+|colonel\s+|the\s+)', '', 'i')"""
_CAN = ", nm AS (SELECT *, lower(trim(regexp_replace(" + _H.format("label") + r", '\s+', ' ', 'g'))) AS norm FROM t_entities), f0 AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY story_ord, ord) AS rn FROM nm), so AS (SELECT norm, list(story ORDER BY story_ord) AS sources FROM (SELECT DISTINCT norm, story, story_ord FROM nm) GROUP BY 1), cn AS (SELECT f0.norm, id, type, label, sources FROM f0 JOIN so USING (norm) WHERE rn = 1) "
_PS = ", ps AS (SELECT * FROM t_sentences WHERE position BETWEEN 10 AND 30), nd AS (SELECT DISTINCT m.story, m.entity, m.id FROM (SELECT story, entity, unnest(sentence_ids) AS id FROM t_mentions) m JOIN ps ON ps.story = m.story AND ps.id = m.id), ce AS (SELECT e.story, e.id AS event, e.s AS id FROM (SELECT story, id, unnest(source_nodes) AS s FROM t_events) e JOIN ps ON ps.story = e.story AND ps.id = e.s) "
_VAR = ", mc AS (SELECT story, entity AS id, sum(mention_count)::BIGINT AS mentions FROM t_mentions GROUP BY 1, 2), vr AS (SELECT e.story, e.id, label, type, regexp_replace(lower(e.id), '[^a-z0-9]+', '_', 'g') AS raw, coalesce(mentions, 0)::BIGINT AS mentions FROM t_entities e LEFT JOIN mc USING (story, id)) "
_CLUSTERS = _CAN + r""", k_n AS (SELECT DISTINCT type || ':' || regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g') AS name, type, regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g') AS raw, norm FROM nm),
k_h AS (SELECT type, norm, min(name) AS head FROM k_n GROUP BY ALL),
k_d AS (SELECT a.type, a.norm, a.head, arg_max(b.norm, length(b.norm)) AS next FROM k_h a JOIN k_h b ON a.type = b.type AND a.norm <> b.norm AND length(b.norm) >= 4 AND ends_with(a.norm, b.norm) GROUP BY ALL),
k_s AS (SELECT min(d.head) AS u, min(h.head) AS v FROM k_d d JOIN k_h h ON h.type = d.type AND h.norm = d.next GROUP BY d.type, d.next HAVING count(*) = 1),
k_l AS (SELECT name AS u, head AS v FROM k_n JOIN k_h USING (type, norm) UNION SELECT u, v FROM k_s
  UNION SELECT a.name, b.name FROM k_n a JOIN k_n b ON a.type = b.type AND starts_with(a.raw, 'mr_part_') AND b.raw = substr(a.raw, 4)),
k_e AS (SELECT u, v FROM k_l UNION SELECT v, u FROM k_l),
k_r AS (SELECT name, name AS o FROM k_n UNION SELECT r.name, e.v FROM k_r r JOIN k_e e ON e.u = r.o)
SELECT name, min(o) AS cluster FROM k_r GROUP BY 1"""
_TAG = r""", g_of AS (SELECT story, unnest(sentence_ids) AS id, entity FROM t_mentions),
g_lab AS (SELECT g.story, g.id, e.ord, g.entity, e.label FROM g_of g JOIN t_entities e ON e.story = g.story AND e.id = g.entity),
g_short AS (SELECT *, regexp_replace(label, '^(Mr\.?|Mrs\.?|Miss|Dr\.?|Professor|Colonel|Inspector)\s+', '', 'i') AS short FROM g_lab),
g_form AS (SELECT story, id, lower(form) AS form, arg_max(entity, (ord, n)) AS entity FROM (SELECT story, id, ord, 0 AS n, label AS form, entity FROM g_lab
  UNION ALL SELECT story, id, ord, 1, short, entity FROM g_short WHERE short <> label AND length(short) > 2) WHERE form <> '' GROUP BY ALL),
g_any AS (SELECT story, id, string_agg(regexp_replace(form, '([.*+?^${}()|\[\]\\])', '\\\1', 'g'), '|' ORDER BY length(form) DESC, form) AS p FROM g_form GROUP BY ALL),
g_cut AS (SELECT s.story, s.id, CASE WHEN p IS NULL THEN [text] ELSE string_split_regex(regexp_replace(text, '(' || p || ')', chr(1) || '\1' || chr(1), 'gi'), chr(1)) END AS c
  FROM t_sentences s LEFT JOIN g_any USING (story, id)),
g_seg AS (SELECT story, id, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM g_cut)
SELECT story, id, count(*)::INT AS n, string_agg(x || '<' || coalesce(entity, '') || '>', '' ORDER BY k) AS spans
FROM (SELECT g.*, f.entity FROM g_seg g LEFT JOIN g_form f ON f.story = g.story AND f.id = g.id AND k % 2 = 0 AND f.form = lower(x)) WHERE x <> '' GROUP BY story, id"""
ORACLES = {
    "reconcile_alias_clusters": T.replace("WITH ", "WITH RECURSIVE ", 1) + _CLUSTERS,
    "analytics_tagged": T + _TAG,
    "analytics_canonical_keys": T + "SELECT story, id, type, key FROM t_canon",
    "analytics_pretty_labels": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label FROM part",
    "analytics_work_summaries": T + _WORKS + "SELECT * FROM w",
    "analytics_entity_summaries": T + "SELECT * FROM t_sum",
    "analytics_raw_ids": T + "SELECT key, story, list(id ORDER BY ord) AS raw_ids FROM t_canon GROUP BY 1, 2",
    "analytics_presence": T + _PRES + "SELECT key, story, id, round(fraction, 6) AS fraction, position FROM pres",
    "analytics_searchable": T + _FRAC + "SELECT story, id, position, round(fraction, 6) AS fraction FROM fr WHERE length(text) >= 12",
    "analytics_search": T + "SELECT story, id, position, text FROM t_sentences WHERE contains(lower(text), 'small ring') ORDER BY story_ord, position LIMIT 50",
    "analytics_scoreboard": T + " SELECT phrase, (SELECT count(*) FROM t_sentences WHERE contains(lower(text), phrase)) AS n FROM (SELECT unnest(['red', 'small ring', 'widget', 'green', 'zzz']) AS phrase)",
    "analytics_co_occurrence": T + _CO + "SELECT * FROM co",
    "analytics_network": T + _CO + "SELECT key, label, total_mentions FROM t_s WHERE key IN (SELECT a FROM co WHERE weight >= 2 UNION SELECT b FROM co WHERE weight >= 2)",
    "analytics_trajectories": M + _SEG + "SELECT * FROM seg",
    "analytics_tracks": M + _SEG + ", c AS (SELECT story, character, count(*) AS segments FROM seg GROUP BY 1, 2), k AS (SELECT *, (row_number() OVER (PARTITION BY story ORDER BY CASE character WHEN 'user_8' THEN 1 WHEN 'user_46' THEN 2 ELSE 3 END, segments DESC, character))::INT AS rank FROM c) SELECT * FROM k WHERE rank <= 8",
    "analytics_frequency": T + _FREQ + "SELECT * FROM fq",
    "analytics_presence_payload": T + _PRES + _SEEN + ", tp AS (SELECT key FROM t_s WHERE type = 'character' AND total_mentions >= 2 ORDER BY total_mentions DESC, so, eo LIMIT 60) SELECT key, story, floor(fraction * 10000 + 0.5) / 10000 AS fraction, position, CASE WHEN length(text) > 140 THEN left(text, 139) || '…' ELSE text END AS text FROM pres WHERE key IN (SELECT key FROM tp)",
    "analytics_presence_totals": T + _PRES + "SELECT key, count(*) AS marks, count(DISTINCT story) AS works FROM pres GROUP BY 1",
    "analytics_long_tail": T + _TAIL + "SELECT * FROM r",
    "analytics_tail_summary": T + _TAIL + "SELECT type, sum(count)::BIGINT AS total, count(*) AS n, round(sum(CASE WHEN rank <= 10 THEN count ELSE 0 END) / sum(count), 8) AS top10_share, sum((count <= 2)::INT)::BIGINT AS few, round(sum((count <= 2)::INT) / count(*), 8) AS few_share FROM r GROUP BY 1",
    "analytics_density": T + _WORKS + "SELECT story, round(entity_count * 1000 / word_count, 6) AS entity_density, round(event_count * 1000 / word_count, 6) AS event_density, round(mention_count * 1000 / word_count, 6) AS mention_density, entity_count + event_count + mention_count AS stack, max(entity_count + event_count + mention_count) OVER () AS largest FROM w",
    "analytics_funnel": T + _WORKS + _FREQ + """SELECT 'books' AS stage, count(*)::BIGINT AS n FROM w UNION ALL SELECT 'sections', sum(section_count)::BIGINT FROM w UNION ALL SELECT 'sentences', sum(sentence_count)::BIGINT FROM w UNION ALL SELECT 'entities', sum(entity_count)::BIGINT FROM w
UNION ALL SELECT 'events', sum(event_count)::BIGINT FROM w UNION ALL SELECT 'mentions', sum(mention_count)::BIGINT FROM w UNION ALL SELECT 'cases', count(*) FROM fq WHERE type = 'case'""",
    "analytics_naming": T + "SELECT DISTINCT s.story, s.id, CASE WHEN length(text) > 90 THEN left(text, 87) || '…' ELSE text END AS snippet FROM (SELECT story, unnest(sentence_ids) AS id FROM t_mentions WHERE regexp_matches(entity, '^(Mr )?Part.1[0-9]$')) m JOIN t_sentences s USING (story, id)",
    "analytics_appearances": T + "SELECT story, sum(len(sentence_ids))::BIGINT AS n FROM t_mentions WHERE regexp_matches(entity, '^(Mr )?Part.1[0-9]$') GROUP BY 1",
    "analytics_shared_sections": T + ", b AS (SELECT story, section, bool_or(regexp_matches(entity, '1$')) AS a, bool_or(regexp_matches(entity, '2$')) AS b FROM t_mentions GROUP BY 1, 2) SELECT story, count(*) AS n FROM b WHERE a AND b GROUP BY 1",
    "analytics_of_section": T + "SELECT DISTINCT m.story, section, e.id, type, label FROM t_mentions m JOIN t_entities e ON e.story = m.story AND e.id = m.entity",
    "analytics_variants": T + "SELECT DISTINCT id FROM t_entities WHERE regexp_matches(id, 'Part.1[0-9]$')",
    "analytics_passage_sentences": T + _PS + "SELECT ps.story, ps.id, position, coalesce(list(entity ORDER BY entity) FILTER (entity IS NOT NULL), []) AS entities FROM ps LEFT JOIN nd USING (story, id) GROUP BY ALL",
    "analytics_passage_events": T + _PS + "SELECT story, event, list(id ORDER BY id) AS source_nodes FROM ce GROUP BY 1, 2",
    "analytics_passage_entities": T + _PS + "SELECT story, entity FROM nd UNION SELECT e.story, unnest(participants) FROM t_events e WHERE (e.story, e.id) IN (SELECT (story, event) FROM ce)",
    "analytics_labelled_clues": C + "SELECT story, ord, 'The ' || speaker AS object_label, 'case_x' AS case_label, CASE WHEN len(recipients) > 0 THEN 'The ' || list_sort(recipients)[1] ELSE 'none' END AS discovered_by_label, 1 AS n, md5(content) AS body FROM c_events",
    "analytics_citations": T + "SELECT story, 'sentence' AS kind, s AS key, list_sort(list(DISTINCT id)) AS ids FROM (SELECT story, id, unnest(source_nodes) AS s FROM t_events) GROUP BY ALL UNION ALL SELECT story, 'entity', entity, list_sort(list(DISTINCT s)) FROM (SELECT story, entity, unnest(sentence_ids) AS s FROM t_mentions) GROUP BY ALL",
    "reconcile_canonical": T + _CAN + "SELECT * FROM cn",
    "reconcile_normalised": T + _CAN + "SELECT cn.id AS canonical, nm.id AS alias, cn.label AS canonical_label, nm.label AS alias_label, nm.story AS source, 'normalised_match' AS reason FROM nm JOIN cn USING (norm) WHERE nm.id <> cn.id",
    "reconcile_suffixes": T + _CAN + "SELECT a.id AS canonical, b.id AS alias, a.label AS canonical_label, b.label AS alias_label, '(cross-source)' AS source, 'suffix_match' AS reason FROM cn a JOIN cn b ON a.type = b.type AND a.norm <> b.norm AND length(b.norm) >= 4 AND ends_with(a.norm, b.norm)",
    "reconcile_split_counts": T + _CAN + "SELECT CASE type WHEN 'character' THEN 'characters' WHEN 'organisation' THEN 'organisations' ELSE 'other' END AS kind, count(*) AS n FROM cn GROUP BY 1",
    "reconcile_cross_references": T + ", h AS (SELECT entity, arg_min(label, m.story_ord) AS label, count(*) AS refs FROM t_mentions m JOIN t_entities e ON e.story = m.story AND e.id = m.entity GROUP BY 1) SELECT entity, label, refs, story AS source, section, mention_count FROM t_mentions JOIN h USING (entity)",
    "reconcile_nested_references": T + ", h AS (SELECT entity, arg_min(label, m.story_ord) AS label FROM t_mentions m JOIN t_entities e ON e.story = m.story AND e.id = m.entity GROUP BY 1) SELECT entity, label, count(*)::INT AS n, md5(string_agg(story || ' ' || section, ',' ORDER BY story, section)) AS body FROM t_mentions JOIN h USING (entity) GROUP BY 1, 2",
    "reconcile_cases": T + "SELECT story, id, label, (ord % 2 = 0)::INT AS n, CASE WHEN ord % 2 = 0 THEN 'o_' || id END AS object FROM t_entities WHERE type = 'case'",
    "reconcile_documents": T + "SELECT id, label, story AS source FROM t_entities WHERE type = 'document'",
    "reconcile_merge_clusters": T + _VAR + ", g AS (SELECT *, regexp_replace(raw, '^mr_', '') AS cluster FROM vr) SELECT cluster, (row_number() OVER (PARTITION BY cluster ORDER BY mentions DESC, story, id))::INT AS rank, story, id, label, mentions, (sum(mentions) OVER (PARTITION BY cluster))::BIGINT AS total FROM g",
    "reconcile_collisions": T + _VAR + r", s AS (SELECT *, trim(regexp_replace(regexp_replace(lower(label), '[^a-z\s]', '', 'g'), '\s+', ' ', 'g')) AS stem FROM vr WHERE contains(lower(label), 'ring')) SELECT CASE WHEN type = 'location' THEN 'loc:' || stem WHEN starts_with(stem, 'the') THEN 'char:the' ELSE 'char:' || stem END AS bucket, count(*) AS variants, sum(mentions)::BIGINT AS mentions FROM s GROUP BY 1",
}
