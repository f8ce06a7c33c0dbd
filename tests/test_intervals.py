import random

import pytest
from pyspark.sql import functions as F

from storygraph.operators import intervals as I
from storygraph.operators import timeline as TL

POINTS, SPANS = "story string, p int, who string", "story string, id int, a int, b int"


def brute(points, spans):
    return sorted((s, p, w, i, a, b) for s, p, w in points for t, i, a, b in spans if s == t and p is not None and a is not None and a <= p and (b is None or p < b))


@pytest.mark.parametrize("high", [1, 7, 64, 5000])
def test_join_equals_brute_force(spark, high):
    rnd = random.Random(high)
    at = lambda: rnd.randrange(high)
    points = [(s, at(), "w") for s in "abc" for _ in range(40)] + [("a", None, "n"), ("a", 0, "z"), ("a", 0, "z"), ("only", 3, "w"), ("b", 10**8, "far")]
    spans = [(s, i, at(), rnd.choice([None, at(), high])) for s in "abd" for i in range(60)] + [("a", 99, None, 5), ("a", 98, 3, 3), ("b", 97, 2**31 - 1, None), ("c", 96, 0, None)]
    got = I.interval_join(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), ["story"], "p", "a", "b")
    assert got.columns == ["story", "p", "who", "id", "a", "b"]
    assert sorted(got.collect(), key=lambda r: tuple((x is not None, x) for x in r)) == sorted(brute(points, spans), key=lambda r: tuple((x is not None, x) for x in r))


def test_nothing_joins_nothing(spark):
    points, spans = spark.createDataFrame([("a", 1, "w")], POINTS), spark.createDataFrame([("a", 1, 0, None)], SPANS)
    assert I.interval_join(points.filter("false"), spans, ["story"], "p", "a", "b").count() == 0
    assert I.interval_join(points, spans.filter("false"), ["story"], "p", "a", "b").count() == 0


def test_work_grows_with_the_matches(spark):
    """One story of n short spans and n points: n pairs match of n * n. Rows that enter the join grow as n log n, and it makes matches alone."""
    seen = []
    for n in (500, 2000, 8000):
        points = spark.range(n).select(F.lit("s").alias("story"), (F.col("id") * 4).cast("int").alias("p"), F.lit("w").alias("who"))
        spans = spark.range(n).select(F.lit("s").alias("story"), F.col("id").cast("int"), (F.col("id") * 4).cast("int").alias("a"), (F.col("id") * 4 + 3).cast("int").alias("b"))
        left, right = I.point_nodes(points, ["story"], "p"), I.interval_nodes(spans, points, ["story"], "p", "a", "b")
        assert left.join(right, ["story", "_level", "_node"]).count() == n == I.interval_join(points, spans, ["story"], "p", "a", "b").count()
        most = left.unionByName(right, allowMissingColumns=True).groupBy("_level", "_node").count().agg(F.max("count")).first()[0]
        seen.append(((left.count() + right.count()) / n, most / n))
    assert seen[-1][0] < seen[0][0] + 2 * 4 + 1  # four more levels
    assert seen[-1][1] <= 1  # no key holds more than the points, which the top level has all


def test_current_section(spark):
    ranges = spark.createDataFrame([("s", "a", 0, 0, 2), ("s", "empty", 1, 2, 0), ("s", "b", 2, 2, 5), ("t", "none", 0, 0, 0)], "story string, section string, idx int, start int, count int")
    heads = spark.createDataFrame([("s", p) for p in (-1, 0, 1, 2, 6, 7, 10**8)] + [("t", 0)], "story string, p int")
    got = {(r["story"], r["p"]): r["section"] for r in TL.current_section(heads, ranges).collect()}
    assert got == {("s", -1): "a", ("s", 0): "a", ("s", 1): "a", ("s", 2): "b", ("s", 6): "b", ("s", 7): "b", ("s", 10**8): "b", ("t", 0): "none"}
