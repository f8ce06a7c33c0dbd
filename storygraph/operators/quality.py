"""Verification and comparison of graphs, result sets and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storygraph.operators.graph import union


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K1: (level, name, n) at all levels, in one pass over each table."""
    g = nodes.groupingSets([["kind"], ["kind", "subkind"], []], "kind", "subkind").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    a = g.filter("_g != 0 OR subkind IS NOT NULL").select(
        F.when(F.col("_g") == 3, "nodes").when(F.col("_g") == 1, "kind").otherwise("subkind").alias("level"), F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, F.col("kind")).otherwise(F.concat_ws("/", "kind", "subkind")).alias("name"), "n"
    )
    e = edges.rollup("rel_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("rel_type").alias("_g"))
    return a.unionByName(e.select(F.when(F.col("_g") == 1, "edges").otherwise("rel_type").alias("level"), F.coalesce("rel_type", F.lit("all")).alias("name"), "n"))


def checked(counts_: DataFrame, expected: DataFrame) -> DataFrame:
    """K1: counts against expected (level, name, expected), 0 where either lacks a row."""
    out = counts_.join(expected, ["level", "name"], "full").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("expected", F.coalesce("expected", F.lit(0)))
    return out.withColumn("delta", F.col("n") - F.col("expected")).withColumn("passed", F.col("n") == F.col("expected"))


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """K2."""
    ids = nodes.select("story", "id").distinct()
    lost = [edges.join(ids.withColumnRenamed("id", end), ["story", end], "left_anti").select(*edges.columns) for end in ("from_id", "to_id")]
    return lost[0].unionByName(lost[1]).distinct()


def self_edges(edges: DataFrame) -> DataFrame:
    """K3."""
    return edges.filter("from_id = to_id")


def stray_nodes(nodes: DataFrame, stories: DataFrame) -> DataFrame:
    """K4: nodes of stories that aren't on the list."""
    return nodes.join(stories.select("story"), "story", "left_anti")


def unreachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K5: entities and events that no edge touches."""
    touched = edges.select("story", F.col("from_id").alias("id")).unionByName(edges.select("story", F.col("to_id").alias("id")))
    return nodes.filter(F.col("kind").isin("entity", "event")).join(touched, ["story", "id"], "left_anti")


def story_count(nodes: DataFrame) -> DataFrame:
    """K6."""
    return nodes.agg(F.countDistinct("story").alias("stories"))


def canonical_json(df: DataFrame, sets: tuple = ()) -> Column:
    """K7: a row as JSON: fields by name, nulls left out, arrays that stand for sets sorted."""
    return F.to_json(F.struct(*[(F.array_sort(c) if c in sets else F.col(c)).alias(c) for c in sorted(df.columns)]))


def digests(df: DataFrame, keys: list[str], sets: tuple = ()) -> DataFrame:
    """K8: for each key 16 hex digits of a SHA-256 over the sums of its rows' SHA-256 halves and their number: the same in any order, and
    added up in parts, so that no task holds a key's hashes."""
    rows = df.select(*keys, F.sha2(canonical_json(df, sets), 256).alias("_h"))
    half = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy(*keys).agg(half(1).alias("_a"), half(16).alias("_b"), F.count(F.lit(1)).alias("size"))
    whole = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("size", "_a", "_b")])
    return sums.select(*keys, F.substring(F.sha2(whole, 256), 1, 16).alias("hash"), "size")


def manifest_mismatches(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """K9: keys whose hash differs, or that one side lacks."""
    j = a.select(*keys, F.col("hash").alias("left")).join(b.select(*keys, F.col("hash").alias("right")), keys, "full")
    return j.filter(~F.col("left").eqNullSafe(F.col("right")))


def order_violations(df: DataFrame, order: str, by: str) -> DataFrame:
    """Rows of a story that stand after one with a larger `by`, in the order of `order`."""
    before = F.lag(by).over(Window.partitionBy("story").orderBy(order))
    return df.withColumn("_before", before).filter(F.col("_before") > F.col(by)).drop("_before")


def first_difference(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """(story, first, left_size, right_size) where the rows of two sides first differ; first is null when they agree."""
    def side(df: DataFrame, name: str) -> DataFrame:
        i = F.row_number().over(Window.partitionBy("story").orderBy(*order)) - 1
        return df.select("story", i.alias("i"), canonical_json(df).alias(name))

    j = side(a, "l").join(side(b, "r"), ["story", "i"], "full")
    return j.groupBy("story").agg(F.min(F.when(~F.col("l").eqNullSafe(F.col("r")), F.col("i"))).alias("first"), F.count("l").alias("left_size"), F.count("r").alias("right_size"))


def run_metrics(runs: dict[str, DataFrame], measures: dict[str, Column]) -> DataFrame:
    """A row for each run (column run) with counts; runs: tables by name, each with run; measures: a condition by table name."""
    parts = []
    for name, df in runs.items():
        parts.append(df.groupBy("run").agg(F.sum(measures.get(name, F.lit(True)).cast("int")).alias("n")).withColumn("metric", F.lit(name)))
    return union(parts).groupBy("metric").pivot("run").agg(F.first("n")).fillna(0)


def bad_citations(cited: DataFrame, sentences: DataFrame) -> DataFrame:
    """By run, sentence ids that are cited and those of them that don't exist. cited: (run, story, ids)."""
    each = cited.select("run", "story", F.explode("ids").alias("id"))
    known = sentences.select("story", "id").distinct().withColumn("_known", F.lit(1))
    j = each.join(known, ["story", "id"], "left")
    return j.groupBy("run").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("_known").isNull().cast("int")).alias("bad"))


def type_histogram(entities: DataFrame, types: list[str]) -> DataFrame:
    """Entities by run and type."""
    return entities.groupBy("run").pivot("type", types).agg(F.count(F.lit(1))).fillna(0)


def case_ids(entities: DataFrame) -> DataFrame:
    """The distinct case ids of each run."""
    return entities.filter("type = 'case'").groupBy("run").agg(F.array_sort(F.collect_set("id")).alias("ids"))
