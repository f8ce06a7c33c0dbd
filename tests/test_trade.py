"""The trade tables: rows that name no part or no order, and how often rows are shuffled."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from storygraph.operators import timeline as TL
from storygraph.operators.ranking import summed_before
from storygraph.plans import registry
from tests.compare import TABLES, same

QUERIES = ["analytics_tagged", "analytics_presence_payload", "analytics_searchable", "analytics_work_summaries", "analytics_citations", "quality_digest_values", "timeline_section_ranges"]


@pytest.fixture(scope="module")
def odd(data, tmp_path_factory):
    """Lines of unknown parts and orders, lines that share a number, the least part of which is unknown, and orders of unknown customers."""
    d = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        if t not in ("lineitem", "orders"):
            os.symlink(f"{data}/{t}.parquet", d / f"{t}.parquet")
    con, copy = duckdb.connect(), "COPY (SELECT * REPLACE ({}) FROM '{}') TO '{}' (FORMAT parquet)"
    key = "CASE WHEN l_partkey % 7 = 3 THEN -l_partkey WHEN l_partkey % 11 = 3 THEN l_partkey + 100000000 ELSE l_partkey END AS l_partkey"
    con.sql(copy.format(f"{key}, CASE WHEN l_orderkey % 13 = 5 THEN l_orderkey + 100000000 ELSE l_orderkey END AS l_orderkey", f"{data}/lineitem.parquet", d / "lineitem.parquet"))
    con.sql(copy.format("CASE WHEN o_orderkey % 17 = 5 THEN o_custkey + 100000000 ELSE o_custkey END AS o_custkey", f"{data}/orders.parquet", d / "orders.parquet"))
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_odd_trade_matches_sql(spark, odd, name):
    same(spark, odd, registry.QUERIES[name], registry.ORACLES[name])


MOST = {"timeline_mention_positions": 90, "timeline_mentions": 360, "analytics_tagged": 40, "analytics_presence_payload": 155}


@pytest.mark.parametrize("name", sorted(MOST))
def test_few_shuffles(spark, data, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= MOST[name]


def test_summed_before(spark):
    rows = [(k, i, (i * 7 + len(k)) % 5) for k in ("a", "bb") for i in range(50)] + [(None, 3, 2), (None, 1, 9)]
    got = summed_before(spark.createDataFrame(rows, "k string, i int, n int"), ["k"], [F.floor(F.col("i") / 8)], [F.col("i")], "n", "before").collect()
    assert {(r["k"], r["i"]): r["before"] for r in got} == {(k, i): sum(n for a, j, n in rows if a == k and j < i) for k, i, _ in rows}


def test_mention_positions_of_odd_mentions(spark):
    mentions = spark.createDataFrame([("s", "a", "x", ["2", "1"]), ("s", "a", "x", ["2", "1"]), ("s", "a", "x", ["2"]), ("s", "a", "y", []), ("s", "a", "z", None), ("s", None, "y", ["no"])], "story string, entity string, section string, sentence_ids array<string>")
    sentences = spark.createDataFrame([("s", "1", "x", 0), ("s", "2", "y", 1)], "story string, id string, section string, position int")
    ranges = TL.section_ranges(spark.createDataFrame([("s", "x", 0), ("s", "y", 1)], "story string, section string, idx int"), sentences)
    got = sorted((r["entity"] or "", r["section"], r["pos"]) for r in TL.mention_positions(mentions, sentences, ranges).collect())
    assert got == [("", "y", 1), ("a", "x", 0), ("a", "x", 1), ("a", "y", 1), ("a", "z", 0)]
