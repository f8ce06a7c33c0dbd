"""Extraction: the payload of a section, and the parsing of the answers. answers: (story, section, section_idx, raw), raw as received."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storygraph.operators.graph import union
from storygraph.schemas import EXTRACTION, TYPE_FIELDS


def payloads(sentences: DataFrame, sections: DataFrame, entities: DataFrame) -> DataFrame:
    """(story, section, lexical_text, known_list); known are the entities first seen in earlier sections. entities: (story, id, type,
    label, first_idx)."""
    lines = F.array_sort(F.collect_list(F.struct("position", F.format_string("[%s] %s", "id", "text").alias("line"))))
    text = sentences.groupBy("story", "section").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lexical_text"))
    s = sections.select("story", "section", "idx")
    known = s.join(entities, "story").filter(F.col("first_idx") < F.col("idx"))
    items = F.array_sort(F.collect_list(F.struct("first_idx", "id", F.format_string("- %s (%s): %s", "id", "type", "label").alias("line"))))
    known = known.groupBy("story", "section").agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("known_list"))
    return text.join(known, ["story", "section"], "left").withColumn("known_list", F.coalesce("known_list", F.lit("(none yet)")))


def _none(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def parsed(answers: DataFrame) -> DataFrame:
    """Answers with parse_ok and p, the six lists; a fence around an answer is dropped, and what isn't JSON gives empty lists."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    out = answers.withColumn("_plain", plain)
    out = out.withColumn("parse_ok", F.try_parse_json("_plain").isNotNull()).withColumn("_p", F.from_json("_plain", EXTRACTION))
    lists = [_none(F.col(f"_p.{f.name}"), f.dataType.simpleString()).alias(f.name) for f in EXTRACTION]
    return out.withColumn("p", F.struct(*lists)).drop("_plain", "_p", "raw")


def _each(answers: DataFrame, name: str) -> DataFrame:
    return answers.select("story", "section", "section_idx", F.posexplode(f"p.{name}").alias("ord", "x")).select("story", "section", "section_idx", "ord", "x.*")


def new_entities(answers: DataFrame) -> DataFrame:
    """Entities with a type and a label always, and the fields of other types left out."""
    e = _each(answers, "newEntities").withColumn("type", F.coalesce(F.nullif("type", F.lit("")), F.lit("object")))
    e = e.withColumn("label", F.coalesce("label", "id")).withColumn("description", F.coalesce("description", F.lit("")))
    for kind, fields in TYPE_FIELDS.items():
        for f in fields:
            e = e.withColumn(f, F.when(F.col("type") == kind, F.nullif(F.col(f), F.lit(""))))
    return e


def events(answers: DataFrame) -> DataFrame:
    """Lists that are missing are empty, but performs stays null."""
    e = _each(answers, "events")
    text = "array<string>"
    return e.withColumn("source_nodes", _none(F.col("source_nodes"), text)).withColumn("participants", _none(F.col("participants"), text)).withColumn("label", F.coalesce("label", "id"))


def state_changes(answers: DataFrame) -> DataFrame:
    return _each(answers, "stateChanges")


def mentions(answers: DataFrame) -> DataFrame:
    """X8."""
    m = _each(answers, "mentions").withColumn("sentence_ids", _none(F.col("sentence_ids"), "array<string>"))
    return m.withColumn("mention_count", F.size("sentence_ids"))


def clues(answers: DataFrame) -> DataFrame:
    """A clue is discovered in the section of its answer."""
    return _each(answers, "clues").withColumn("discovered_in_section", F.col("section")).withColumn("source_nodes", _none(F.col("source_nodes"), "array<string>"))


def members(answers: DataFrame) -> DataFrame:
    return _each(answers, "memberOf")


def section_stats(answers: DataFrame) -> DataFrame:
    """What each section yields, and running totals of its story."""
    by = Window.partitionBy("story").orderBy("section_idx").rowsBetween(Window.unboundedPreceding, 0)
    n = {"entities": "newEntities", "events": "events", "states": "stateChanges"}
    out = answers.select("story", "section", "section_idx", *[F.size(f"p.{c}").alias(k) for k, c in n.items()])
    return out.select("*", *[F.sum(k).over(by).alias(f"total_{k}") for k in n])


def ingest_totals(answers: DataFrame) -> DataFrame:
    """One row."""
    n = {"entities": "newEntities", "events": "events", "states": "stateChanges", "mentions": "mentions", "clues": "clues"}
    return answers.agg(F.count(F.lit(1)).alias("sections"), *[F.coalesce(F.sum(F.size(f"p.{c}")), F.lit(0)).alias(k) for k, c in n.items()])


def forbidden(tables: list[DataFrame], terms: list[str]) -> DataFrame:
    """(story, term) for terms that any row of layer 2 holds."""
    rows = union([t.select("story", F.to_json(F.struct(*t.columns)).alias("row")) for t in tables])
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("row"), t))
    return rows.select("story", F.explode(found).alias("term")).distinct()


def unsourced(states: DataFrame, events_: DataFrame, clues_: DataFrame) -> DataFrame:
    """(story, problem, id)."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return union(
        [
            states.filter(F.coalesce("valid_from", F.lit("")) == "").select("story", F.lit("state without valid_from").alias("problem"), "id"),
            states.filter(empty("caused_by")).select("story", F.lit("state without caused_by").alias("problem"), "id"),
            events_.filter(empty("source_nodes")).select("story", F.lit("event without source").alias("problem"), "id"),
            clues_.filter(empty("source_nodes")).select("story", F.lit("clue without source").alias("problem"), F.col("object").alias("id")),
        ]
    )


def bad_references(entities: DataFrame, clues_: DataFrame, members_: DataFrame, mentions_: DataFrame) -> DataFrame:
    """(story, problem, id): references to entities that are missing, or of another type."""
    def lost(df: DataFrame, column: str, problem: str, type_: str | None = None) -> DataFrame:
        known = entities.filter(F.col("type") == type_) if type_ else entities
        ids = df.select("story", F.col(column).alias("id")).filter("id IS NOT NULL AND id != ''").distinct()
        return ids.join(known.select("story", "id"), ["story", "id"], "left_anti").select("story", F.lit(problem).alias("problem"), "id")

    documents = entities.filter("type = 'document'")
    parts = [lost(clues_, "case", "clue of no case", "case"), lost(clues_, "object", "clue of no object"), lost(clues_, "discovered_by", "clue of no finder")]
    parts += [lost(members_, "organisation", "member of no organisation", "organisation"), lost(members_, "character", "member that is none"), lost(mentions_, "entity", "mention of none")]
    parts += [lost(documents, c, f"document {c} none") for c in ("from", "to") if c in entities.columns]
    return union(parts)
