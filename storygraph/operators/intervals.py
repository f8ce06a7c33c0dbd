"""Joins of points with the intervals that hold them, within a story or another key.

The axis is halved again and again; a node is one part of one level. An interval is the sum of a few nodes that do not overlap, two of a
level at most; a point lies in one node of each level. So both sides meet in an equi-join on (key, level, node), each matching pair in
exactly one node: what the join makes is the result, and no pair of a long story is looked at in vain. Rows of a long story are spread
over its nodes, so no task has to hold them all. A point becomes as many rows as the axis of its key has levels, an interval twice as
many at most; both only as far as the key's last point reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(position: Column, level: str) -> Column:
    return F.call_function("shiftright", position, F.col(level))


def point_nodes(points: DataFrame, keys: list[str], point: str) -> DataFrame:
    """points with (_level, _node), a row for each level of its key. Negative points count as 0, null ones go."""
    at = F.greatest(F.col(point).cast("long"), F.lit(0))
    top = points.groupBy(*keys).agg(F.length(F.bin(F.max(at))).alias("_levels"))
    each = points.filter(F.col(point).isNotNull()).join(top, keys).withColumn("_level", F.explode(F.sequence(F.lit(0), "_levels")))
    return each.withColumn("_node", _at(at, "_level")).drop("_levels")


def interval_nodes(intervals: DataFrame, points: DataFrame, keys: list[str], point: str, start: str, end: str | None) -> DataFrame:
    """intervals with (_level, _node), a row for each node that they are made of; from start (null: never) to before end (null: for ever)."""
    top = points.groupBy(*keys).agg(F.length(F.bin(F.max(F.greatest(F.col(point).cast("long"), F.lit(0))))).alias("_levels"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_levels"))
    last = F.least(F.coalesce(F.col(end).cast("long"), size), size) if end else size
    rows = intervals.filter(F.col(start).isNotNull()).join(top, keys).withColumns({"_iv_from": F.greatest(F.col(start).cast("long"), F.lit(0)), "_iv_to": last}).filter("_iv_from < _iv_to")
    # On level k the part that is left runs from ceil(from / 2^k) to floor(to / 2^k); an odd end of it is a node, the rest goes one level up.
    parts = """filter(flatten(transform(sequence(0, _levels), k -> transform(
        array(struct(shiftright(_iv_from + shiftleft(1L, k) - 1, k) AS l, shiftright(_iv_to, k) AS r)),
        x -> struct(k AS level, if(x.l < x.r AND x.l % 2 = 1, x.l, null) AS a, if(x.l < x.r AND x.r % 2 = 1, x.r - 1, null) AS b)))), x -> x.a IS NOT NULL OR x.b IS NOT NULL)"""
    rows = rows.withColumn("_part", F.explode(F.expr(parts)))
    rows = rows.withColumn("_node", F.explode(F.array_compact(F.array("_part.a", "_part.b"))))
    return rows.withColumn("_level", F.col("_part.level")).drop("_iv_from", "_iv_to", "_levels", "_part")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str | None = None) -> DataFrame:
    """Each pair of a point and an interval of its keys with start <= point < end, with the columns of both."""
    both = [*keys, "_level", "_node"]
    met = point_nodes(points, keys, point).join(interval_nodes(intervals, points, keys, point, start, end), both)
    return met.select(*points.columns, *[c for c in intervals.columns if c not in keys])


def reached(playheads: DataFrame, items: DataFrame, position: str = "pos") -> DataFrame:
    """playheads (story, p, ...) with the items (story, <position>, ...) that they have reached: position <= p.

    An item stays reached for ever, so about half of all pairs of a story are the result: a plain join on the story and a filter. Nodes
    would only multiply the items here.
    """
    return playheads.join(items, "story").filter(F.col(position) <= F.col("p"))
