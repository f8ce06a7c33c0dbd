"""The two-table graph: nodes (story, kind, id, subkind, name, pos, props) and edges (story, from_id, to_id, rel_type, windows, props).

Ids are unique within a story only, so every join is on (story, id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.schemas import ENTITY_TYPES, KINDS, RELATIONS, TYPE_FIELDS

NODE = ("story", "kind", "id", "subkind", "name", "pos", "props")
EDGE = ("story", "from_id", "to_id", "rel_type", "valid_from_section", "valid_to_section", "props")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _node(df: DataFrame, kind: str, id_, subkind=None, name=None, pos=None, **props) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "story",
        F.lit(kind).alias("kind"),
        F.col(id_).alias("id"),
        (F.col(subkind) if subkind else none).cast("string").alias("subkind"),
        (F.col(name) if name else none).cast("string").alias("name"),
        (F.col(pos) if pos else none).cast("int").alias("pos"),
        (F.to_json(F.struct(*[F.col(c).alias(k) for k, c in props.items()])) if props else F.lit("{}")).alias("props"),
    )


def event_positions(events: DataFrame, sections: DataFrame) -> DataFrame:
    """Events with pos, the index of their section; 0 where the section is unknown."""
    s = sections.select("story", "section", F.col("idx").alias("pos"))
    return events.join(s, ["story", "section"], "left").withColumn("pos", F.coalesce("pos", F.lit(0)))


def known_entities(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of a known type, and the others."""
    known = F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False))
    return entities.filter(known), entities.filter(~known)


def nodes(stories: DataFrame, sections: DataFrame, sentences: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """G1. Extra columns of entities (the fields of a type) go to their props; nulls are left out there."""
    extra = [f for fields in TYPE_FIELDS.values() for f in fields] + ["description", "first_section"]
    e = event_positions(events, sections)
    if "communicates" in e.columns:
        e = e.withColumn("_speaker", F.col("communicates.speaker")).withColumn("_content", F.col("communicates.content"))
    else:
        e = e.withColumn("_speaker", F.lit(None).cast("string")).withColumn("_content", F.lit(None).cast("string"))
    return union(
        [
            _node(stories, "story", "story", name="name", sourceFile="source_file"),
            _node(sections, "section", "section", name="title", pos="idx", wordCount="word_count"),
            _node(sentences, "lexical", "id", pos="position", section="section", text="text"),
            _node(known_entities(entities)[0], "entity", "id", "type", "label", **{c: c for c in extra if c in entities.columns}),
            _node(e, "event", "id", name="label", pos="pos", section="section", sourceNodes="source_nodes", speakerId="_speaker", communicatesContent="_content"),
        ]
    )


def _edge(df: DataFrame, from_, to, rel: str | None, start=None, end=None, props=None) -> DataFrame:
    return df.select(
        "story",
        F.col(from_).alias("from_id"),
        F.col(to).alias("to_id"),
        (F.lit(rel) if rel else F.col("rel_type")).alias("rel_type"),
        (F.col(start) if start else F.lit(None)).cast("int").alias("valid_from_section"),
        (F.col(end) if end else F.lit(None)).cast("int").alias("valid_to_section"),
        (props if props is not None else F.lit("{}")).alias("props"),
    )


def event_edges(events: DataFrame) -> DataFrame:
    """G3."""
    parts = [_edge(events.select("story", "id", F.explode("participants").alias("who")), "who", "id", "PARTICIPATED_IN")]
    if "performs" in events.columns:
        parts.append(_edge(events.select("story", "id", F.explode("performs").alias("who")), "who", "id", "PERFORMED"))
    if "communicates" in events.columns:
        said = events.filter("communicates IS NOT NULL")
        parts.append(_edge(said.filter("communicates.speaker != ''").select("story", "id", F.col("communicates.speaker").alias("who")), "who", "id", "SPOKE_IN"))
        parts.append(_edge(said.select("story", "id", F.explode("communicates.recipients").alias("who")), "id", "who", "TOLD_TO"))
    return union(parts)


def windowed_edges(states: DataFrame, events: DataFrame) -> DataFrame:
    """States (story, from, to, type, valid_from, valid_until) with event ids turned into section indexes.

    An unknown start is 0; an unknown end is open. events: with pos.
    """
    at = events.select("story", "id", "pos")
    a, b = at.withColumnsRenamed({"id": "valid_from", "pos": "_start"}), at.withColumnsRenamed({"id": "valid_until", "pos": "_end"})
    s = states.join(a, ["story", "valid_from"], "left").join(b, ["story", "valid_until"], "left")
    s = s.withColumn("_start", F.coalesce("_start", F.lit(0))).withColumn("rel_type", F.col("type"))
    return _edge(s, "from", "to", None, "_start", "_end", F.to_json(F.struct(F.col("valid_from").alias("validFrom"), F.col("valid_until").alias("validUntil"))))


def mention_edges(mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """At a point in time, so only the lower bound is set."""
    s = sections.select("story", "section", F.col("idx").alias("_idx"))
    m = mentions.join(s, ["story", "section"], "left").withColumn("_idx", F.coalesce("_idx", F.lit(0)))
    return _edge(m, "entity", "section", "MENTIONED_IN", "_idx", None, F.to_json(F.struct(F.col("mention_count").alias("mentionCount"), F.col("sentence_ids").alias("sentenceIds"))))


def clue_edges(clues: DataFrame, sections: DataFrame) -> DataFrame:
    """G5."""
    s = sections.select("story", F.col("section").alias("discovered_in_section"), F.col("idx").alias("_idx"))
    c = clues.join(s, ["story", "discovered_in_section"], "left").withColumn("_idx", F.coalesce("_idx", F.lit(0)))
    return _edge(c, "object", "case", "CLUE_FOR", "_idx", None, F.to_json(F.struct(F.col("discovered_by").alias("discoveredBy"), "significance")))


def member_edges(members: DataFrame, events: DataFrame) -> DataFrame:
    """Windows as in G4."""
    m = members.select("story", F.col("character").alias("from"), F.col("organisation").alias("to"), F.lit("MEMBER_OF").alias("type"), "valid_from", "valid_until")
    return windowed_edges(m, events)


def _ends(edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    """edges with the kinds of their ends; of nodes that share an id the later kind wins."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    kinds = nodes_.select("story", "id", "kind").groupBy("story", "id").agg(F.max_by("kind", rank).alias("kind"))
    a = kinds.withColumnsRenamed({"id": "from_id", "kind": "from_kind"})
    b = kinds.withColumnsRenamed({"id": "to_id", "kind": "to_kind"})
    return edges.join(a, ["story", "from_id"], "left").join(b, ["story", "to_id"], "left")


def _fits() -> F.Column:
    pairs = F.create_map(*[F.lit(x) for r, k in RELATIONS.items() for x in (r, "|".join(k))])
    return F.coalesce(F.concat_ws("|", F.coalesce("from_kind", F.lit("?")), F.coalesce("to_kind", F.lit("?"))) == F.try_element_at(pairs, "rel_type"), F.lit(False))


def checked_edges(edges: DataFrame, nodes_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges whose ends have the kinds that their relation asks for, and the others with an `undeclared` flag."""
    ends = _ends(edges, nodes_)
    return ends.filter(_fits()).select(*edges.columns), ends.filter(~_fits()).select(*edges.columns, (~F.col("rel_type").isin(*RELATIONS)).alias("undeclared"))


def dropped_counts(edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    """G8."""
    return checked_edges(edges, nodes_)[1].groupBy("story", "rel_type").agg(F.count(F.lit(1)).alias("dropped"))


def totals(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by story, and overall (story null), in one pass over each."""
    n = nodes_.rollup("story").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.rollup("story").agg(F.count(F.lit(1)).alias("edges")).withColumnRenamed("story", "_s")
    return n.join(e, F.col("story").eqNullSafe(F.col("_s")), "left").select("story", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def key_violations(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, story, id): node ids that repeat in a story, and ends of edges that are no node."""
    twice = nodes_.groupBy("story", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate id").alias("problem"), "story", "id")
    ends = edges.select("story", F.col("from_id").alias("id")).unionByName(edges.select("story", F.col("to_id").alias("id"))).distinct()
    return twice.unionByName(ends.join(nodes_.select("story", "id"), ["story", "id"], "left_anti").select(F.lit("missing end").alias("problem"), "story", "id"))


def skipped_entities(entities: DataFrame) -> DataFrame:
    return known_entities(entities)[1].select("story", "id", "type", "label")
