"""Reconciliation across stories: canonical entities, merge candidates, cross-references and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.functions import text as X


def canonical(entities: DataFrame) -> DataFrame:
    """H2: (norm, id, type, label, sources): the first entity of each normalised label, and the stories that have it, in order.

    The first is found by a minimum, which is added up in parts, so a label that many stories share isn't sorted in one task.
    """
    n = entities.withColumn("norm", X.normal_label(F.col("label")))
    first = n.groupBy("norm").agg(F.min(F.struct("story_ord", "ord", "id", "type", "label")).alias("e"))
    by_story = n.groupBy("norm", "story").agg(F.min(F.struct("story_ord", "ord")).alias("at"))
    sources = by_story.groupBy("norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "story"))), lambda x: x["story"]).alias("sources"))
    return first.join(sources, "norm").select("norm", "e.id", "e.type", "e.label", "sources")


def normalised_candidates(entities: DataFrame, canonical_: DataFrame) -> DataFrame:
    """H3: entities whose label is that of a canonical entity of another id."""
    n = entities.withColumn("norm", X.normal_label(F.col("label")))
    c = canonical_.select("norm", F.col("id").alias("canonical"), F.col("label").alias("canonical_label"))
    return n.join(c, "norm").filter("id != canonical").select("canonical", F.col("id").alias("alias"), "canonical_label", F.col("label").alias("alias_label"), F.col("story").alias("source"), F.lit("normalised_match").alias("reason"))


def suffix_candidates(canonical_: DataFrame, shortest: int = 4) -> DataFrame:
    """H4: a label that ends in another of its type. Every proper suffix is looked up, which takes the labels' lengths, not their pairs."""
    c = canonical_.select("norm", "id", "type", "label")
    cut = F.explode(F.sequence(F.lit(2), F.length("norm") - (shortest - 1)))
    tails = c.filter(F.length("norm") > shortest).select("type", "id", "label", "norm", cut.alias("k"))
    tails = tails.select("type", F.col("id").alias("canonical"), F.col("label").alias("canonical_label"), F.substring(F.col("norm"), F.col("k"), F.length("norm")).alias("norm"))
    short = c.select("norm", "type", F.col("id").alias("alias"), F.col("label").alias("alias_label"))
    return tails.join(short, ["type", "norm"]).select("canonical", "alias", "canonical_label", "alias_label", F.lit("(cross-source)").alias("source"), F.lit("suffix_match").alias("reason"))


def split_counts(canonical_: DataFrame) -> DataFrame:
    """H5."""
    kind = F.when(F.col("type") == "character", "characters").when(F.col("type") == "organisation", "organisations").otherwise("other")
    return canonical_.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def cross_references(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """H6: flat: each mention of an entity id, with the id's label in its first story and its number of references."""
    m = mentions.join(entities.select("story", F.col("id").alias("entity"), "label"), ["story", "entity"], "left")
    heads = m.groupBy("entity").agg(F.min_by("label", "story_ord").alias("label"), F.count(F.lit(1)).alias("refs")).withColumn("label", F.coalesce("label", "entity"))
    return mentions.join(heads, "entity").select("entity", "label", "refs", F.col("story").alias("source"), "section", "mention_count", "sentence_ids")


def nested_references(flat: DataFrame) -> DataFrame:
    """H6, nested: one row for each entity; its array grows with the entity's mentions."""
    return flat.groupBy("entity", "label").agg(F.array_sort(F.collect_list(F.struct("source", "section", "mention_count", "sentence_ids"))).alias("refs"))


def cases(entities: DataFrame, clues: DataFrame) -> DataFrame:
    """H7: cases with their story's clues, an empty array where there are none."""
    own = clues.groupBy("story", F.col("case").alias("id")).agg(F.array_sort(F.collect_list(F.struct("object", "discovered_by", "significance"))).alias("clues"))
    none = F.array().cast("array<struct<object:string,discovered_by:string,significance:string>>")
    return entities.filter("type = 'case'").join(own, ["story", "id"], "left").select("story", "id", "label", F.coalesce("clues", none).alias("clues"))


def document_catalogue(entities: DataFrame) -> DataFrame:
    """H8."""
    return entities.filter("type = 'document'").select("id", "label", F.col("story").alias("source"), *[c for c in ("document_type", "from", "to", "content_summary", "first_section") if c in entities.columns])


def merge_clusters(variants: DataFrame, groups: DataFrame) -> DataFrame:
    """H9: the variants of each alias group with their rank by mentions and the group's total. groups: (raw, cluster)."""
    v = variants.join(groups, "raw")
    by = Window.partitionBy("cluster").orderBy(F.desc("mentions"), "story", "id")
    total = v.groupBy("cluster").agg(F.sum("mentions").alias("total"))
    return v.withColumn("rank", F.row_number().over(by)).join(total, "cluster").select("cluster", "rank", "story", "id", "label", "mentions", "total")


def collision_buckets(variants: DataFrame, pattern: str, title: str) -> DataFrame:
    """Entities whose label matches, by what they are: a place, one with a title, or another label."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.lower("label"), r"[^a-z\s]", ""), r"\s+", " "))
    v = variants.filter(F.col("label").rlike(pattern)).withColumn("stem", stem)
    bucket = F.when(F.col("type") == "location", F.concat(F.lit("loc:"), "stem")).when(F.col("stem").startswith(title), F.lit(f"char:{title}")).otherwise(F.concat(F.lit("char:"), "stem"))
    return v.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("variants"), F.sum("mentions").alias("mentions"))
