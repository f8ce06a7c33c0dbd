"""Layer 3: who can know what at which section, and what holds there. Keys come as tables; one key is a table of one row.

A fact first known at position p is known at every later cutoff, so facts are kept once and only joined with the keys asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.operators.graph import union
from storygraph.operators.intervals import interval_join
from storygraph.schemas import STATES


def facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q1, Q2: (story, character, event, pos, modality, id, description, confidence), one row for each edge; repeated edges repeat."""
    e = nodes.filter("kind = 'event'").select("story", F.col("id").alias("event"), "name", "pos", F.get_json_object("props", "$.communicatesContent").alias("content"))
    seen = edges.filter("rel_type = 'PARTICIPATED_IN'").select("story", F.col("from_id").alias("character"), F.col("to_id").alias("event"), F.lit("OBSERVED").alias("modality"))
    told = edges.filter("rel_type = 'TOLD_TO'").select("story", F.col("to_id").alias("character"), F.col("from_id").alias("event"), F.lit("TOLD").alias("modality"))
    out = seen.unionByName(told).join(e, ["story", "event"])
    observed = F.col("modality") == "OBSERVED"
    return out.select(
        "story",
        "character",
        "event",
        "pos",
        "modality",
        F.concat_ws("_", F.when(observed, "obs").otherwise("belief"), "event", "character").alias("id"),
        F.when(observed, F.coalesce("name", F.lit(""))).otherwise(F.coalesce("content", "name", F.lit(""))).alias("description"),
        F.when(observed, 1.0).otherwise(0.7).alias("confidence"),
    )


def knowledge(facts_: DataFrame, keys: DataFrame) -> DataFrame:
    """Q6 (state), Q7: facts known to each key. keys: (story, character, section, cutoff)."""
    return keys.join(facts_, ["story", "character"]).filter(F.col("pos") <= F.col("cutoff"))


def all_keys(nodes: DataFrame) -> DataFrame:
    """Q7: every character with every section of its story."""
    who = nodes.filter("kind = 'entity' AND subkind = 'character'").select("story", F.col("id").alias("character"))
    return who.join(nodes.filter("kind = 'section'").select("story", F.col("id").alias("section"), F.col("pos").alias("cutoff")), "story")


def resolved_keys(keys: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q6: keys (story, character, section) with cutoff, and the ones whose section or character is unknown, with what is missing."""
    s = nodes.filter("kind = 'section'").select("story", F.col("id").alias("section"), F.col("pos").alias("cutoff"))
    c = nodes.filter("kind = 'entity'").select("story", F.col("id").alias("character"), F.col("name").alias("label"))
    out = keys.join(s, ["story", "section"], "left").join(c.withColumn("_known", F.lit(True)), ["story", "character"], "left")
    problem = F.when(F.col("cutoff").isNull(), "unknown section").when(F.col("_known").isNull(), "unknown character")
    out = out.withColumn("problem", problem)
    return out.filter("problem IS NULL").drop("_known", "problem"), out.filter("problem IS NOT NULL").select(*keys.columns, "problem")


def events(nodes: DataFrame, edges: DataFrame, with_performs: bool = True) -> DataFrame:
    """Q3, Q4: events with their participants, performers and recipients as sorted sets; performs null when empty or not asked for;
    communicates null when there is no content."""
    e = nodes.filter("kind = 'event'")
    links = edges.filter(F.col("rel_type").isin("PARTICIPATED_IN", "PERFORMED", "TOLD_TO"))
    told = F.col("rel_type") == "TOLD_TO"
    links = links.select("story", F.when(told, F.col("from_id")).otherwise(F.col("to_id")).alias("id"), F.when(told, F.col("to_id")).otherwise(F.col("from_id")).alias("who"), "rel_type")
    sets = links.groupBy("story", "id").agg(*[F.array_sort(F.collect_set(F.when(F.col("rel_type") == r, F.col("who")))).alias(n) for r, n in (("PARTICIPATED_IN", "participants"), ("PERFORMED", "performs"), ("TOLD_TO", "recipients"))])
    none = F.array().cast("array<string>")
    content = F.get_json_object("props", "$.communicatesContent")
    speech = F.struct(F.coalesce(F.get_json_object("props", "$.speakerId"), F.lit("")).alias("speaker"), F.coalesce("recipients", none).alias("recipients"), content.alias("content"))
    return e.join(sets, ["story", "id"], "left").select(
        "story",
        "id",
        F.col("name").alias("label"),
        "pos",
        F.get_json_object("props", "$.section").alias("section"),
        F.coalesce("participants", none).alias("participants"),
        F.when((F.size("performs") > 0) & F.lit(with_performs), F.col("performs")).alias("performs"),
        F.when(F.length(content) > 0, speech).alias("communicates"),
    )


def entities(nodes: DataFrame) -> DataFrame:
    """Q5: entities with the fields of their props; a missing type is object, empty fields are null."""
    get = lambda f: F.nullif(F.get_json_object("props", f"$.{f}"), F.lit(""))
    fields = ("description", "first_section", "client", "crime_type", "outcome", "primary_location", "document_type", "org_type")
    return nodes.filter("kind = 'entity'").select("story", "id", F.coalesce("subkind", F.lit("object")).alias("type"), F.col("name").alias("label"), *[get(f).alias(f) for f in fields])


def visible_events(nodes: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Q6: (story, section) with the events up to it. Depends on no character, so it is joined once per section asked for."""
    return cutoffs.join(nodes.filter("kind = 'event'").select("story", F.col("id").alias("event"), F.col("name").alias("label"), "pos"), "story").filter(F.col("pos") <= F.col("cutoff"))


def document_knowledge(events_: DataFrame, sections: DataFrame, keys: DataFrame) -> DataFrame:
    """Q8: the same from event arrays: once for each event, without falling back to its label; an event of an unknown section counts
    as before all; a key of an unknown section knows nothing."""
    s = sections.select("story", "section", "idx")
    e = events_.join(s, ["story", "section"], "left").withColumn("pos", F.coalesce("idx", F.lit(-1))).drop("idx", "section")
    who = e.select("story", "id", "pos", F.explode(F.array_distinct("participants")).alias("character"), F.lit("OBSERVED").alias("modality"), F.col("label").alias("description"))
    told = e.filter("communicates IS NOT NULL").select("story", "id", "pos", F.explode(F.array_distinct("communicates.recipients")).alias("character"), F.lit("TOLD").alias("modality"), F.col("communicates.content").alias("description"))
    k = keys.join(s.withColumnRenamed("idx", "cutoff"), ["story", "section"])
    return k.join(who.unionByName(told), ["story", "character"]).filter(F.col("pos") <= F.col("cutoff"))


def knows_via(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q9: (story, character, event, name, pos, knows_via), two equi-joins instead of one on either end."""
    e = nodes.filter("kind = 'event'").select("story", F.col("id").alias("event"), "name", "pos")
    a = edges.filter(F.col("rel_type").isin("PARTICIPATED_IN", "PERFORMED", "SPOKE_IN")).select("story", F.col("from_id").alias("character"), F.col("to_id").alias("event"), F.col("rel_type").alias("knows_via"))
    b = edges.filter("rel_type = 'TOLD_TO'").select("story", F.col("to_id").alias("character"), F.col("from_id").alias("event"), F.col("rel_type").alias("knows_via"))
    return a.unionByName(b).join(e, ["story", "event"])


def met_so_far(nodes: DataFrame, n: int) -> DataFrame:
    """Q10: entities and events up to n; entities have no position and come first."""
    return nodes.filter(F.col("kind").isin("entity", "event") & (F.col("pos").isNull() | (F.col("pos") <= n))).select("story", "kind", "id", "name", "pos")


def state_at(edges: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Q11: what holds for each key (story, entity, n): the windows of (story, entity) that n lies in."""
    s = edges.filter(F.col("rel_type").isin(*STATES)).withColumnRenamed("from_id", "entity")
    t = nodes.select("story", F.col("id").alias("to_id"), F.col("name").alias("target_label"))
    return interval_join(keys, s, ["story", "entity"], "n", "valid_from_section", "valid_to_section").join(t, ["story", "to_id"]).select("story", "entity", "n", "rel_type", F.col("to_id").alias("target_id"), F.coalesce("target_label", F.lit("")).alias("target_label"))


def listed_stories(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """The stories of a whitelist in its order; order: (story, ord)."""
    return nodes.filter("kind = 'story'").join(order, "story").select("story", "name", "ord")


def numbered_states(edges: DataFrame) -> DataFrame:
    """Q14: state edges in order, numbered state_0, state_1, ... in each story."""
    by = Window.partitionBy("story").orderBy("from_id", "to_id", "rel_type", "valid_from_section", "valid_to_section")
    s = edges.filter(F.col("rel_type").isin(*STATES))
    return s.select("story", F.concat(F.lit("state_"), (F.row_number().over(by) - 1).cast("string")).alias("id"), "from_id", "to_id", "rel_type", "valid_from_section", "valid_to_section")


def payload_mentions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q15: mentions in the order of their sections, from the edges' props."""
    m = edges.filter("rel_type = 'MENTIONED_IN'")
    s = nodes.filter("kind = 'section'").select("story", F.col("id").alias("to_id"), "pos")
    ids = F.coalesce(F.from_json(F.get_json_object("props", "$.sentenceIds"), "array<string>"), F.array().cast("array<string>"))
    return m.join(s, ["story", "to_id"]).select("story", F.col("from_id").alias("entity"), F.col("to_id").alias("section"), "pos", F.get_json_object("props", "$.mentionCount").cast("int").alias("mention_count"), ids.alias("sentence_ids"))


def payload(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Q13: the parts of a story, each row with n, its place: sections and sentences by pos, entities by id, events by pos and id; the
    story itself with its granularity, "sentence" where that is unknown."""

    def placed(df: DataFrame, *order: str) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy("story").orderBy(*order)) - 1)

    get = lambda f: F.get_json_object("props", f"$.{f}")
    kind = lambda k: nodes.filter(F.col("kind") == k)
    known = F.when(get("granularity").isin("sentence", "paragraph"), get("granularity")).otherwise("sentence")
    return {
        "stories": kind("story").select("story", "name", get("sourceFile").alias("source_file"), known.alias("granularity")),
        "sections": placed(kind("section"), "pos", "id").select("story", "n", "id", F.col("name").alias("title"), "pos", get("wordCount").cast("int").alias("word_count")),
        "sentences": placed(kind("lexical"), "pos", "id").select("story", "n", "id", "pos", get("section").alias("section"), get("text").alias("text")),
        "entities": placed(entities(nodes), "id"),
        "events": placed(events(nodes, edges), "pos", "id"),
    }


def payload_clues(edges: DataFrame) -> DataFrame:
    """Q15: clues in the order of the sections where they are found, from the edges' props; n is their place in the story."""
    get = lambda f: F.coalesce(F.get_json_object("props", f"$.{f}"), F.lit(""))
    by = Window.partitionBy("story").orderBy("valid_from_section", "from_id", "to_id", "props")
    c = edges.filter("rel_type = 'CLUE_FOR'").withColumn("n", F.row_number().over(by) - 1)
    made = [get("discoveredBy").alias("discovered_by"), get("significance").alias("significance")]
    return c.select("story", "n", F.col("from_id").alias("object"), F.col("to_id").alias("case"), "valid_from_section", *made)


def payload_members(edges: DataFrame) -> DataFrame:
    """Q15: memberships by character and organisation."""
    by = Window.partitionBy("story").orderBy("from_id", "to_id", "valid_from_section")
    m = edges.filter("rel_type = 'MEMBER_OF'").withColumn("n", F.row_number().over(by) - 1)
    return m.select("story", "n", F.col("from_id").alias("character"), F.col("to_id").alias("organisation"), "valid_from_section", "valid_to_section")


def present(events_: DataFrame, entities_: DataFrame) -> DataFrame:
    """Q16: the characters of each section, in order of first appearance."""
    e = events_.select("story", "section", "ord", F.posexplode("participants").alias("i", "id"))
    e = e.join(entities_.filter("type = 'character'").select("story", "id"), ["story", "id"], "left_semi")
    first = e.groupBy("story", "section", "id").agg(F.min(F.struct("ord", "i")).alias("at"))
    return first.groupBy("story", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("characters"))


def readable(stories: DataFrame, having: DataFrame) -> DataFrame:
    """Q17: stories with at least one row of `having` (sentences, or examples), by name."""
    return stories.join(having.select("story").distinct(), "story", "left_semi").orderBy("name")


def _block(df: DataFrame, keys: list[str], line: F.Column, out: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "event", line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(out))


def prompts(keys: DataFrame, facts_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q18: for each key (story, character, section, cutoff, label) the three blocks of a prompt, "  (none)" where one is empty."""
    k = ["story", "character", "section"]
    known = knowledge(facts_, keys)
    observed = _block(known.filter("modality = 'OBSERVED'"), k, F.format_string("  - %s [event %s]", "description", "event"), "observed")
    told = _block(known.filter("modality = 'TOLD'"), k, F.format_string('  - "%s" (told via event %s)', "description", "event"), "told")
    own = facts_.filter("modality = 'OBSERVED'").select("story", "character", "event", "pos", "description").distinct()
    own = keys.join(own, ["story", "character"]).filter(F.col("pos") <= F.col("cutoff"))
    witnessed = _block(own, k, F.format_string("  - [%s] %s", "event", "description"), "witnessed")
    out = keys
    for part in (witnessed, observed, told):
        out = out.join(part, k, "left")
    return out.select(*k, *[F.coalesce(c, F.lit("  (none)")).alias(c) for c in ("witnessed", "observed", "told")])


def dossier(keys: DataFrame, events_: DataFrame, states: DataFrame, mentions: DataFrame, clues: DataFrame, members: DataFrame) -> DataFrame:
    """Q20: (story, entity, n, facet, ref) for keys (story, entity, n). events: (story, id, pos, participants, recipients); states:
    edges with windows; mentions, clues: with idx, null (unknown section) counting as beyond all."""
    e = events_.select("story", F.col("id").alias("ref"), "pos", F.explode(F.array_distinct(F.concat("participants", "recipients"))).alias("entity"), F.lit("event").alias("facet"))
    s = union([states.select("story", F.col(a).alias("entity"), F.col("valid_from_section").alias("pos"), F.concat_ws(" ", "from_id", "rel_type", "to_id").alias("ref"), F.lit(f"state {b}").alias("facet")) for a, b in (("from_id", "from"), ("to_id", "to"))])
    m = mentions.select("story", "entity", F.col("idx").alias("pos"), F.col("section").alias("ref"), F.lit("mention").alias("facet"))
    parts = [e.select("story", "entity", "pos", "ref", "facet"), s.select("story", "entity", "pos", "ref", "facet"), m.select("story", "entity", "pos", "ref", "facet")]
    parts += [clues.select("story", F.col(r).alias("entity"), F.col("idx").alias("pos"), F.col("object").alias("ref"), F.lit(f"clue {r}").alias("facet")) for r in ("case", "object", "discovered_by")]
    parts += [members.select("story", F.col(r).alias("entity"), F.col("valid_from_section").alias("pos"), F.concat_ws(" in ", "character", "organisation").alias("ref"), F.lit(f"member {r}").alias("facet")) for r in ("character", "organisation")]
    return keys.join(union(parts), ["story", "entity"]).filter(F.col("pos") <= F.col("n")).select("story", "entity", "n", "facet", "ref")


def subgraph(cutoffs: DataFrame, events_: DataFrame, states: DataFrame) -> DataFrame:
    """Q21: links (story, section, kind, source, target) up to each (story, section, cutoff): state edges with both ends taking part in
    an event so far, participation and speech."""
    seen = cutoffs.join(events_.drop("section"), "story").filter(F.col("pos") <= F.col("cutoff"))
    part = seen.select("story", "section", "id", F.explode("participants").alias("who"))
    who = part.select("story", "section", "who").distinct()
    s = cutoffs.select("story", "section").join(states, "story")
    for end in ("from_id", "to_id"):
        s = s.join(who.withColumnRenamed("who", end), ["story", "section", end], "left_semi")
    said = seen.filter("communicates IS NOT NULL").select("story", "section", F.col("communicates.speaker").alias("source"), F.explode("communicates.recipients").alias("target"))
    return union(
        [
            s.select("story", "section", F.lit("state").alias("kind"), F.col("from_id").alias("source"), F.col("to_id").alias("target")),
            part.select("story", "section", F.lit("participation").alias("kind"), F.col("who").alias("source"), F.col("id").alias("target")),
            said.select("story", "section", F.lit("comm").alias("kind"), "source", "target"),
        ]
    )
