"""The sentence-precise timeline: first positions of events, mentions and entities, and what a playhead sees.

playheads: (story, p), or (story, p, character); a table of many is as good as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.operators.graph import union
from storygraph.operators.intervals import interval_join, reached


def section_ranges(sections: DataFrame, sentences: DataFrame) -> DataFrame:
    """TL1: (story, section, idx, start, count)."""
    n = sentences.groupBy("story", "section").agg(F.count(F.lit(1)).alias("count"))
    s = sections.select("story", "section", "idx").join(n, ["story", "section"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    before = F.sum("count").over(Window.partitionBy("story").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("start", F.coalesce(before, F.lit(0)))


def current_section(playheads: DataFrame, ranges: DataFrame) -> DataFrame:
    """TL2: the first section that ends after the playhead, else the last one."""
    # Sections follow one another without gaps, so a playhead lies in one of them at most, and the ones before it end before it.
    keys, ends = playheads.columns, ranges.groupBy("story").agg(F.min(F.struct("idx", "section")).alias("_first"), F.max(F.struct("idx", "section")).alias("_last"))
    spans = ranges.select("story", F.struct("idx", "section").alias("_in"), "start", (F.col("start") + F.col("count")).alias("_end"))
    held = interval_join(playheads.distinct(), spans, ["story"], "p", "start", "_end").select(*[F.col(k).alias(f"_{k}") for k in keys], "_in")
    out = playheads.distinct().join(ends, "story").join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    s = F.when(F.col("p") < 0, F.col("_first")).otherwise(F.coalesce("_in", "_last")).alias("s")
    return out.select(*keys, s).select(*keys, "s.section", "s.idx")


def first_positions(items: DataFrame, sentences: DataFrame, ranges: DataFrame) -> DataFrame:
    """TL3: items (story, key, section, ids) with pos, the earliest sentence of ids, else the start of the section (of an unknown one the first)."""
    at = sentences.select("story", F.col("id").alias("sid"), "position")
    found = items.select("story", "key", F.explode("ids").alias("sid")).join(at, ["story", "sid"]).groupBy("story", "key").agg(F.min("position").alias("_min"))
    first = ranges.filter("idx = 0").select("story", F.col("start").alias("_zero"))
    out = items.join(found, ["story", "key"], "left").join(ranges.select("story", "section", "start"), ["story", "section"], "left").join(first, "story", "left")
    return out.select("story", "key", "section", F.coalesce("_min", "start", "_zero", F.lit(0)).alias("pos"))


def event_positions(events: DataFrame, sentences: DataFrame, ranges: DataFrame) -> DataFrame:
    """TL4: (story, id, pos)."""
    return first_positions(events.select("story", F.col("id").alias("key"), "section", F.col("source_nodes").alias("ids")), sentences, ranges).select("story", F.col("key").alias("id"), "pos")


def mention_positions(mentions: DataFrame, sentences: DataFrame, ranges: DataFrame) -> DataFrame:
    """TL4: (story, entity, section, pos); of several mentions in a section each has its own. As first_positions, but mentions go on
    with their sentences' ids instead of being joined with what is found, and equal ones fall together on the way."""
    at = sentences.select("story", F.col("id").alias("_sid"), "position")
    each = mentions.filter("story IS NOT NULL").select("story", "entity", "section", "sentence_ids", F.explode_outer("sentence_ids").alias("_sid"))
    met = each.join(at, ["story", "_sid"], "left").select("story", "section", "entity", "sentence_ids", "position").repartition("story", "section")
    found = met.groupBy("story", "section", "entity", "sentence_ids").agg(F.min("position").alias("_min"))
    out = found.join(ranges.select("story", "section", "start"), ["story", "section"], "left")  # an unknown section counts as the first, which starts at 0
    return out.select("story", "entity", "section", F.coalesce("_min", "start", F.lit(0)).alias("pos"))


def entity_positions(events: DataFrame, event_pos: DataFrame, mention_pos: DataFrame) -> DataFrame:
    """TL4: the first position at which an entity takes part, is told or is mentioned; entities that never appear have none."""
    e = events.join(event_pos, ["story", "id"])
    parts = [e.select("story", F.explode("participants").alias("id"), "pos"), mention_pos.select("story", F.col("entity").alias("id"), "pos")]
    if "communicates" in events.columns:
        parts.append(e.select("story", F.explode("communicates.recipients").alias("id"), "pos"))
    return union(parts).groupBy("story", "id").agg(F.min("pos").alias("pos"))


def visible_events(playheads: DataFrame, events: DataFrame, event_pos: DataFrame) -> DataFrame:
    """TL5: events reached; with a character in playheads, the ones it takes part in or is told."""
    e = reached(playheads, events.join(event_pos, ["story", "id"]))
    if "character" in playheads.columns:
        told = F.array_contains("communicates.recipients", F.col("character")) if "communicates" in events.columns else F.lit(False)
        e = e.filter(F.col("character").isNull() | F.array_contains("participants", F.col("character")) | F.coalesce(told, F.lit(False)))
    return e


def mentions_reached(playheads: DataFrame, mention_pos: DataFrame, current: DataFrame) -> DataFrame:
    """TL6: (story, p, entity, sections, here): the sections where an entity's mention is reached, and whether the current one is."""
    m = reached(playheads.select("story", "p").distinct(), mention_pos)
    m = m.join(current.select("story", "p", F.col("section").alias("_here")), ["story", "p"])
    return m.groupBy("story", "p", "entity").agg(F.array_sort(F.collect_list("section")).alias("sections"), F.bool_or(F.col("section") == F.col("_here")).alias("here"))


def visible_entities(playheads: DataFrame, entities: DataFrame, entity_pos: DataFrame, seen_events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """TL7: entities reached; with a character, only itself and those that take part in the events it can see."""
    e = entities.filter(F.col("type").isin(*types)) if types else entities
    out = reached(playheads, e.join(entity_pos, ["story", "id"]))
    if "character" not in playheads.columns:
        return out
    keys = ["story", "p", "character"]
    scope = seen_events.select(*keys, F.explode("participants").alias("id")).unionByName(playheads.select(*keys, F.col("character").alias("id"))).distinct()
    return out.join(scope, [*keys, "id"], "left_semi")


def active_edges(playheads: DataFrame, edges: DataFrame, event_pos: DataFrame, seen: DataFrame, past: bool = True) -> DataFrame:
    """TL8: edges (story, from, to, ..., valid_from, valid_until by event ids) begun at a playhead, with both ends in view, and whether they
    still hold; an unknown start is the beginning, an unknown end never comes."""
    a = event_pos.select("story", F.col("id").alias("valid_from"), F.col("pos").alias("_from"))
    b = event_pos.select("story", F.col("id").alias("valid_until"), F.col("pos").alias("_until"))
    e = edges.join(a, ["story", "valid_from"], "left").join(b, ["story", "valid_until"], "left").withColumn("_from", F.coalesce("_from", F.lit(0)))
    heads = playheads.select("story", "p").distinct()
    e = reached(heads, e, "_from") if past else interval_join(heads, e, ["story"], "p", "_from", "_until")
    for end in ("from", "to"):
        e = e.join(seen.select("story", "p", F.col("id").alias(end)).distinct(), ["story", "p", end], "left_semi")
    e = e.withColumn("active", F.col("_until").isNull() | (F.col("p") < F.col("_until"))).drop("_from", "_until")
    return e


def visible_clues(playheads: DataFrame, clues: DataFrame, sentences: DataFrame, ranges: DataFrame, seen: DataFrame) -> DataFrame:
    """TL9: clues (story, object, case, discovered_in_section, source_nodes) reached, with both ends in view."""
    items = clues.select("story", F.to_json(F.struct("object", "case", "source_nodes")).alias("key"), F.col("discovered_in_section").alias("section"), F.col("source_nodes").alias("ids")).distinct()
    c = first_positions(items, sentences, ranges).select("story", F.get_json_object("key", "$.object").alias("object"), F.get_json_object("key", "$.case").alias("case"), "pos")
    c = reached(playheads.select("story", "p").distinct(), c)
    for end in ("object", "case"):
        c = c.join(seen.select("story", "p", F.col("id").alias(end)).distinct(), ["story", "p", end], "left_semi")
    return c


def entering(entity_pos: DataFrame) -> DataFrame:
    """TL10: new entities for each sentence where there are any."""
    return entity_pos.groupBy("story", "pos").agg(F.count(F.lit(1)).alias("entering"))


def section_event_counts(sections: DataFrame, events: DataFrame) -> DataFrame:
    """TL11: 0 for a section without events."""
    n = events.groupBy("story", "section").agg(F.count(F.lit(1)).alias("events"))
    return sections.select("story", "section", "idx").join(n, ["story", "section"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def snapshot(seen_events: DataFrame, seen: DataFrame, states: DataFrame, clues: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """TL12: (story, p, kind, source, target, label, active) of all that a playhead shows."""
    at = seen.select("story", "p", F.col("id").alias("target")).distinct()
    part = seen_events.select("story", "p", F.col("id").alias("target"), F.explode("participants").alias("source"), "performs")
    part = part.join(at.withColumnRenamed("target", "source"), ["story", "p", "source"], "left_semi")
    acts = F.coalesce(F.array_contains("performs", F.col("source")), F.lit(False))
    said = seen_events.filter("communicates IS NOT NULL").select("story", "p", F.col("communicates.speaker").alias("source"), F.explode("communicates.recipients").alias("target"), F.substring("communicates.content", 1, 60).alias("label"))
    said = said.join(at, ["story", "p", "target"], "left_semi")
    yes = F.lit(True).alias("active")
    parts = [
        states.select("story", "p", F.lit("state").alias("kind"), F.col("from").alias("source"), F.col("to").alias("target"), F.col("type").alias("label"), "active"),
        part.select("story", "p", F.lit("participation").alias("kind"), "source", "target", F.when(acts, "performs").otherwise("witness").alias("label"), yes),
        said.select("story", "p", F.lit("communicates").alias("kind"), "source", "target", "label", yes),
    ]
    if clues is not None:
        parts.append(clues.select("story", "p", F.lit("clue").alias("kind"), F.col("object").alias("source"), F.col("case").alias("target"), F.lit("clue").alias("label"), yes))
    if members is not None:
        parts.append(members.select("story", "p", F.lit("member").alias("kind"), F.col("from").alias("source"), F.col("to").alias("target"), F.lit("member").alias("label"), "active"))
    return union(parts)
