"""K8, K9, K11 on trees of digests: what two stored tables differ in, found by descending only where digests differ.

`plant` writes a table's rows by leaf and, last, a table of digests for each level above. A digest is a number of rows and two sums of the
halves of their SHA-256, so a node's digest is the sum of its children's, whatever order or task they come from. Two kinds of leaves:
- with `ids`, leaves are ranges of a hash of the ids, and rows that differ are found whatever else was put in or left out (K9);
- with `order`, leaves are runs of each story's rows in that order, and each row counts with its number, so that the first leaf that
  differs holds the first row that differs (K11).

Equal tables read the digests of the top alone; other rows are read of the leaves that differ, from the folders that hold these.

Defined cases: null ids and stories are values; rows that repeat count as often as they stand; a story that one side lacks
differs from its first row on; tables with no rows are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.operators.quality import canonical_json
from storygraph.operators.ranking import numbered
from storygraph.sources.io import read_typed, write_typed

#: Children of a node, and levels of nodes below the top, leaves included.
FAN, LEVELS = 64, 3
#: Rows of a leaf in order; leaves by ids are FAN ** LEVELS in number.
RUN = 1024
PARTS = 256


def _sums(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("_n", "_a", "_b")])


def plant(df: DataFrame, path: str, ids: list[str] | None = None, order: list[str] | None = None) -> None:
    """Writes df and its tree under path. With order, df has story; the first column of order is a number."""
    spark, names = df.sparkSession, df.columns
    if (ids is None) == (order is None):
        raise ValueError("give either ids or order")
    if order:
        first = F.floor(F.col(order[0]) / RUN)
        df = numbered(df, ["story"], [first], [F.col(c) for c in order], "_i")
        df = df.withColumn("_i", F.col("_i").cast("long") - 1).withColumn("_group", F.col("story").cast("string")).withColumn("_leaf", F.floor(F.col("_i") / RUN))
    else:
        leaf = F.pmod(F.xxhash64(*ids), F.lit(FAN**LEVELS))
        df = df.withColumn("_i", F.lit(0).cast("long")).withColumn("_group", F.lit("")).withColumn("_leaf", leaf)
    df = df.withColumn("_part", F.pmod(F.xxhash64("_group", "_leaf"), F.lit(PARTS)).cast("int"))
    keys = ["_part", "_group", "_leaf"]
    write_typed(df.repartitionByRange(*keys, "_i", F.xxhash64(*names)).sortWithinPartitions(*keys), f"{path}/rows", "_part")
    rows = read_typed(spark, f"{path}/rows")
    h = F.sha2(F.concat_ws(" ", F.col("_i").cast("string"), canonical_json(rows.select(*names))), 256)
    half = lambda at: F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")
    each = rows.select("_group", "_leaf", h.alias("_h")).select("_group", F.col("_leaf").alias("_node"), F.lit(1).cast("long").alias("_n"), half(1).alias("_a"), half(16).alias("_b"))
    level = _sums(each, "_group", "_node")
    for k in range(LEVELS):
        level.repartitionByRange("_group", "_node").sortWithinPartitions("_group", "_node").write.parquet(f"{path}/level{k}")
        level = _sums(spark.read.parquet(f"{path}/level{k}").withColumn("_node", F.floor(F.col("_node") / FAN)), "_group", "_node")
    _sums(spark.read.parquet(f"{path}/level{LEVELS - 1}"), "_group").write.parquet(f"{path}/top")


def _both(spark: SparkSession, a: str, b: str, name: str) -> DataFrame:
    """A table of both trees, with _w, the side: -1 or 1."""
    read = read_typed if name == "rows" else lambda session, path: session.read.parquet(path)
    sides = [read(spark, f"{p}/{name}").withColumn("_w", F.lit(w)) for p, w in ((a, -1), (b, 1))]
    return sides[0].unionByName(sides[1])


def _against(both: DataFrame, *by: str) -> DataFrame:
    """(*by, left_size, right_size, _same) of nodes of two trees: a node's digests are equal if they cancel out."""
    size = lambda w: F.sum(F.when(F.col("_w") == w, F.col("_n")).otherwise(0))
    same = [F.sum(F.col(c) * F.col("_w")) == 0 for c in ("_n", "_a", "_b")]
    return both.groupBy(*by).agg(size(-1).alias("left_size"), size(1).alias("right_size"), (same[0] & same[1] & same[2]).alias("_same"))


def tops(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(story, left_size, right_size, same): K8, K9 by story (one row with an empty story for trees by ids)."""
    return _against(_both(spark, a, b, "top"), "_group").withColumnsRenamed({"_group": "story", "_same": "same"})


def leaves(spark: SparkSession, a: str, b: str, first: bool = False) -> DataFrame:
    """(_group, _node): the leaves that differ, or the first of each story. A level is compared below nodes that differ alone."""
    differ = tops(spark, a, b).filter("NOT same").select(F.col("story").alias("_group"))
    on = F.col("_group").eqNullSafe(F.col("_of"))
    for k in reversed(range(LEVELS)):
        up = differ.withColumnsRenamed({"_group": "_of", "_node": "_up"})
        below = on & (F.floor(F.col("_node") / FAN) == F.col("_up")) if "_up" in up.columns else on
        level = _both(spark, a, b, f"level{k}").join(up, below, "left_semi")
        differ = _against(level, "_group", "_node").filter("NOT _same").select("_group", "_node")
        if first:
            differ = differ.groupBy("_group").agg(F.min("_node").alias("_node"))
    return differ


def _opened(spark: SparkSession, a: str, b: str, first: bool) -> DataFrame:
    """The rows of both sides in the leaves that differ. The driver holds at most PARTS numbers of folders."""
    found = leaves(spark, a, b, first).withColumnsRenamed({"_group": "_of", "_node": "_at"})
    parts = [r[0] for r in found.select(F.pmod(F.xxhash64("_of", "_at"), F.lit(PARTS)).cast("int")).distinct().collect()]
    on = F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_leaf") == F.col("_at"))
    rows = _both(spark, a, b, "rows").filter(F.col("_part").isin(parts)).join(found, on, "left_semi")
    return rows.withColumn("_row", canonical_json(rows.drop("_part", "_group", "_leaf", "_i", "_w")))


def first_difference(spark: SparkSession, a: str, b: str) -> DataFrame:
    """K11 of two trees by order: (story, first, left_size, right_size); first is null where the sides agree."""
    side = lambda w: F.max(F.when(F.col("_w") == w, F.col("_row")))
    each = _opened(spark, a, b, True).groupBy("_group", "_i").agg(side(-1).alias("l"), side(1).alias("r"))
    first = each.filter(~F.col("l").eqNullSafe(F.col("r"))).groupBy("_group").agg(F.min("_i").alias("first"))
    t = tops(spark, a, b)
    return t.join(first, F.col("story").eqNullSafe(F.col("_group")), "left").select("story", "first", "left_size", "right_size")


def changes(spark: SparkSession, a: str, b: str, ids: list[str]) -> DataFrame:
    """K9 by row, of two trees by ids: (*ids, change): added, removed or changed; with several rows of the same ids, changed if their
    sets of rows or their numbers differ."""
    each = _opened(spark, a, b, False)
    rows = each.groupBy(*ids, "_row").agg(F.sum("_w").alias("_d"), F.sum((F.col("_w") < 0).cast("int")).alias("_l"), F.sum((F.col("_w") > 0).cast("int")).alias("_r"))
    of = rows.groupBy(*ids).agg(F.max(F.col("_d") != 0).alias("_differs"), F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    kind = F.when(F.col("_l") == 0, "added").when(F.col("_r") == 0, "removed").otherwise("changed")
    return of.filter("_differs").select(*ids, kind.alias("change"))
