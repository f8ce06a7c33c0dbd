"""Layer 2: state changes to windows, the registry of entities, memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.functions.text import guessed_type


def state_windows(changes: DataFrame) -> DataFrame:
    """(story, id, from, to, type, valid_from, valid_until, caused_by). changes: (story, section_idx, ord, from, to, type,
    caused_by_event); each change of (from, type) ends the one before. Numbered by the first appearance of (from, type), then order."""
    key = ["story", "from", "type"]
    by = Window.partitionBy(*key).orderBy("section_idx", "ord")
    w = changes.withColumn("valid_until", F.lead("caused_by_event").over(by)).withColumn("_first", F.first(F.struct("section_idx", "ord")).over(by))
    n = F.row_number().over(Window.partitionBy("story").orderBy("_first", "section_idx", "ord"))
    return w.select(
        "story", F.concat(F.lit("state_"), n.cast("string")).alias("id"), "from", "to", "type", F.col("caused_by_event").alias("valid_from"), "valid_until", F.array("caused_by_event").alias("caused_by")
    )


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def registry(new: DataFrame, clues: DataFrame, members: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities, the first definition of an id winning; ids that only clues, memberships or mentions name get a stub.

    All tables have (story, section_idx, ord); new: (id, type, label).
    """
    stub = lambda df, c, prio: df.select("story", "section_idx", "ord", F.lit(prio).alias("prio"), F.col(c).alias("id")).filter("id != ''")
    parts = [stub(clues, "case", 1), stub(clues, "object", 2), stub(clues, "discovered_by", 3), stub(members, "character", 4), stub(members, "organisation", 5), stub(mentions, "entity", 6)]
    stubs = parts[0]
    for p in parts[1:]:
        stubs = stubs.unionByName(p)
    stubs = stubs.withColumn("type", guessed_type(F.col("id"))).withColumn("label", F.regexp_replace("id", "_", " "))
    rows = new.select("story", "section_idx", "ord", F.lit(0).alias("prio"), "id", "type", "label").filter("id != ''").unionByName(stubs)
    return first_of(rows, ["story", "id"], ["section_idx", "prio", "ord"]).select("story", "id", "type", "label", F.col("section_idx").alias("first_idx"), (F.col("prio") > 0).alias("stub"))


def healed(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with stubs for mentions that name none; their label loses a leading type word."""
    lost = mentions.select("story", F.col("entity").alias("id")).distinct().join(entities.select("story", "id"), ["story", "id"], "left_anti").filter("id != ''")
    label = F.regexp_replace(F.regexp_replace("id", "^[a-z]+_", ""), "_", " ")
    return entities.select("story", "id", "type", "label").unionByName(lost.select("story", "id", guessed_type(F.col("id")).alias("type"), label.alias("label")))


def memberships(members: DataFrame) -> DataFrame:
    """X11: the first row of each (character, organisation)."""
    return first_of(members, ["story", "character", "organisation"], ["section_idx", "ord"])
