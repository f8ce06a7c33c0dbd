"""Chains of telling and false beliefs: a story by hand, random ones against brute force, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from storygraph.operators import belief as B
from storygraph.sources.io import keeper
from tests.test_story import CHANGES, EVENTS, TYPES

EVENT = "story string, id string, section string, ord int, participants array<string>, communicates struct<speaker string, recipients array<string>, content string>"
CHANGE = "story string, from string, to string, type string, event string"


@pytest.fixture()
def told(spark, tmp_path):
    def run(events, changes, labels, sections=2):
        keep = keeper(spark, f"file://{tmp_path}")
        s = spark.createDataFrame([("s", f"section_{i + 1}", i) for i in range(sections)], "story string, section string, idx int")
        e = spark.createDataFrame([("s", i, sec, n, p, c) for n, (i, sec, p, c) in enumerate(events)], EVENT).withColumn("t0", F.lit("clashes"))
        at = keep(B.times(e, s))
        e = keep(e.withColumnRenamed("id", "event").join(at, ["story", "event"]))
        known = B.earliest(e, keep)
        c = spark.createDataFrame([("s", *x) for x in changes], CHANGE)
        lab = spark.createDataFrame([("s", i, x) for i, x in labels.items()], "story string, id string, label string")
        said = B.claims(e, lab, c)
        who = lab.select("story", F.col("id").alias("character"))
        states = B.beliefs_at(B.section_keys(at, who), B.belief_windows(B.learned(known, c, e, said)), B.truth_windows(c, at))
        return known, said, states

    return run


def _at(states, who, of, section):
    return {(r["believed"], r["actual"], r["is_false"]) for r in states.filter((F.col("character") == who) & (F.col("from") == of) & (F.col("section") == section)).collect()}


SALLY = [(i, s, p, None) for i, s, p in EVENTS]
LABELS = {i: i.replace("_", " ").capitalize() for i in TYPES}


def test_sally_is_wrong(told):
    states = told(SALLY, CHANGES, LABELS)[2].cache()
    for n in (0, 1):
        assert _at(states, "sally", "marble", n) == {("red_basket", "blue_box", True)}
        assert _at(states, "anne", "marble", n) == {("blue_box", "blue_box", False)}
    assert _at(states, "sally", "sally", 1) == {("red_basket", "red_basket", False)} and _at(states, "anne", "sally", 1) == set()


def test_telling_sets_right_and_a_lie_wrong(told):
    truth = [*SALLY, ("event_9", "section_2", ["anne"], ("anne", ["sally"], "Hello!"))]  # all that Anne knows goes with it
    assert _at(told(truth, CHANGES, LABELS)[2], "sally", "marble", 1) == {("blue_box", "blue_box", False)}
    lie = [*SALLY, ("event_9", "section_2", ["anne"], ("anne", ["sally"], "It was in the blue box. Now the MARBLE is in the red basket!"))]
    known, said, states = told(lie, CHANGES, LABELS)
    assert [(r["from"], r["to"]) for r in said.collect()] == [("marble", "red_basket")]
    assert _at(states, "sally", "marble", 1) == {("red_basket", "blue_box", True)} and _at(states, "anne", "marble", 1) == {("blue_box", "blue_box", False)}
    assert known.filter("character = 'sally' AND event = 'event_3'").first()["known_at"] == 8


def brute(events):
    """known[(event, character)], by playing the story from its start."""
    known, has = {}, {}
    for t, (i, _, p, c) in enumerate(events, 1):
        news = {(x, i) for x in p or [] if x is not None}
        for r in (c[1] or []) if c else []:
            if r is not None:
                news |= {(r, i)} | {(r, e) for e in (has.get(c[0], set()) if c[0] is not None else ())}
        for who, e in news:
            has.setdefault(who, set()).add(e)
            known.setdefault((e, who), t)
    return known


@pytest.mark.parametrize("seed", range(3))
def test_earliest_like_brute_force(told, seed):
    rnd, who = random.Random(seed), [f"c{i}" for i in range(7)]
    some = lambda n: rnd.sample([*who, None], rnd.randint(0, n)) or None
    events = [(f"e{i:03}", f"section_{i // 20 + 1}", some(2), (rnd.choice([*who, None]), some(2), None) if rnd.random() < 0.4 else None) for i in range(60)]
    known = told(events, [], {w: w for w in who}, 3)[0]
    assert {(r["event"], r["character"]): r["known_at"] for r in known.collect()} == brute(events)


def test_late_news_of_old_changes(told):
    events = [("a", "section_1", ["x", "y"], None), ("b", "section_1", ["x", "z"], None), ("c", "section_1", [], ("y", ["z"], None))]
    states = told(events, [("m", "old", "OWNS", "a"), ("m", "new", "OWNS", "b")], {"x": "x", "y": "y", "z": "z", "m": "m"}, 1)[2]
    assert _at(states, "z", "m", 0) == {("new", "new", False)} and _at(states, "y", "m", 0) == {("old", "new", True)}


def test_words_without_truth_and_labels(told):
    events = [("a", "section_1", [], ("x", ["y"], "m is old now; m-n, mold")), ("b", "section_1", ["x"], None)]
    known, said, states = told(events, [("m", "old", "OWNS", "b")], {"x": "", "y": "!", "m": "m", "old": "Old", "n": "n o"}, 1)
    assert [(r["event"], r["from"], r["to"]) for r in said.collect()] == [("a", "m", "old")]
    assert _at(states, "y", "m", 0) == {("old", "old", False)} and known.count() == 2


def test_empty(told):
    known, said, states = told([], [], {})
    assert known.count() == said.count() == states.count() == 0


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stories_are_read_once(spark, data):
    """No rounds: a shuffle of the events by story, and for states one of the distinct states and entities before it."""
    from storygraph.plans import belief_plans

    assert _exchanges(belief_plans.earliest(spark, data)) == 1
    assert _exchanges(belief_plans.beliefs(spark, data)) <= 3


@pytest.mark.parametrize("seed", range(3))
def test_states_like_windows(spark, told, seed):
    """One reading of a story against claims, windows and interval joins; lies, speakers who are told their own lies, and batches of a few rows."""
    rnd, who, things = random.Random(seed), [f"c{i}" for i in range(5)], ["red box", "blue box", "hat"]
    some = lambda n: rnd.sample([*who, None], rnd.randint(0, n)) or None
    events, changes = [], []
    for i in range(80):
        words = rnd.choice([None, "", " has ".join(rnd.sample([*who, *things], 3))])
        events.append((f"e{i:03}", f"section_{i // 20 + 1}", some(2), (rnd.choice([*who, None]), some(2), words) if rnd.random() < 0.6 else None))
        changes += [(rnd.choice(who), rnd.choice(things).replace(" ", "_"), rnd.choice(["OWNS", "IS_INSIDE"]), f"e{i:03}") for _ in range(rnd.choice([0, 0, 1, 2]))]
    labels = {w: w for w in who} | {t.replace(" ", "_"): t.upper() for t in things}
    want = told(events, changes, labels, 4)[2]
    asked = want.filter(F.col("character").isin(who))
    by = {}
    for a, b, t, e in changes:
        by.setdefault(e, []).append((a, t, b))
    rows = [("s", i, int(s[-1]) - 1, n, p, c, by.get(i)) for n, (i, s, p, c) in enumerate(events)]
    e = spark.createDataFrame(rows, "story string, event string, pos int, ord int, participants array<string>, communicates struct<speaker string, recipients array<string>, content string>, changes array<struct<from string, type string, to string>>")
    named = spark.createDataFrame([("s", i, "character" if i in who else "object", x) for i, x in labels.items()], "story string, id string, type string, label string")
    other = lambda df: df.withColumn("story", F.lit("r"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = B.states(e.unionByName(other(e)), named.unionByName(other(named)))
        plain = lambda df, s: sorted(map(repr, df.select(F.lit(s).alias("story"), *sorted(set(want.columns) - {"story"})).collect()))
        rows_ = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.createDataFrame(rows_, got.schema)
    assert plain(got.filter("story = 's'"), "s") == plain(asked, "s") and plain(got.filter("story = 'r'"), "s") == plain(asked, "s") and asked.filter("is_false").count() > 5


def test_states_empty(spark):
    e = spark.createDataFrame([], "story string, event string, pos int, ord int, participants array<string>, communicates struct<speaker string, recipients array<string>, content string>, changes array<struct<from string, type string, to string>>")
    assert B.states(e, spark.createDataFrame([("s", "a", "character", "a")], "story string, id string, type string, label string")).count() == 0
