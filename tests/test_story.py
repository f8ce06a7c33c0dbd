"""A small story of false belief, by hand: who knows where the marble is."""

import json

import pytest
from pyspark.sql import functions as F

from storygraph.operators import extraction as E
from storygraph.operators import graph as G
from storygraph.operators import objective as O
from storygraph.operators import perspective as P
from storygraph.sources import io
from storygraph.streaming import ingest

EVENTS = [  # id, section, participants
    ("event_0", "section_1", ["sally", "garden"]),
    ("event_1", "section_1", ["sally", "marble", "red_basket"]),
    ("event_2", "section_1", ["sally", "house"]),
    ("event_3", "section_1", ["anne", "marble", "red_basket", "blue_box"]),
    ("event_4", "section_1", ["sally", "garden"]),
    ("event_2_1", "section_2", ["sally", "red_basket"]),
    ("event_2_2", "section_2", ["anne", "marble", "blue_box"]),
]
CHANGES = [  # from, to, type, event
    ("marble", "red_basket", "IS_INSIDE", "event_1"),
    ("marble", "blue_box", "IS_INSIDE", "event_3"),
    ("marble", "blue_box", "IS_INSIDE", "event_2_2"),
    ("sally", "garden", "LOCATED_AT", "event_0"),
    ("sally", "house", "LOCATED_AT", "event_2"),
    ("sally", "garden", "LOCATED_AT", "event_4"),
    ("sally", "red_basket", "LOCATED_AT", "event_2_1"),
]
TYPES = {"anne": "character", "sally": "character", "garden": "location", "house": "location", "marble": "object", "red_basket": "object", "blue_box": "object"}


@pytest.fixture(scope="module")
def story(spark):
    sections = spark.createDataFrame([("s", "section_1", 0, "One", 170), ("s", "section_2", 1, "Two", 96)], "story string, section string, idx int, title string, word_count int")
    events = spark.createDataFrame([("s", i, i, s, [], p) for i, s, p in EVENTS], "story string, id string, label string, section string, source_nodes array<string>, participants array<string>")
    entities = spark.createDataFrame([("s", i, t, i) for i, t in TYPES.items()], "story string, id string, type string, label string")
    stories = spark.createDataFrame([("s", "S", "s.md")], "story string, name string, source_file string")
    sentences = spark.createDataFrame([("s", "sentence_1", "section_1", 0, "x")], "story string, id string, section string, position int, text string")
    order = {e: i for i, (e, _, _) in enumerate(EVENTS)}
    changes = spark.createDataFrame([("s", int(e.startswith("event_2_")), order[e], a, b, t, e) for a, b, t, e in CHANGES], "story string, section_idx int, ord int, from string, to string, type string, caused_by_event string")
    windows = O.state_windows(changes)
    placed = G.event_positions(events, sections)
    return {"nodes": G.nodes(stories, sections, sentences, entities, events), "edges": G.event_edges(events).unionByName(G.windowed_edges(windows, placed)), "windows": windows, "entities": entities, "events": events, "sections": sections}


def test_windows(story):
    got = {(r["from"], r["to"], r["valid_from"], r["valid_until"]) for r in story["windows"].collect()}
    assert {("marble", "red_basket", "event_1", "event_3"), ("marble", "blue_box", "event_3", "event_2_2"), ("marble", "blue_box", "event_2_2", None)} <= got
    assert {("sally", "garden", "event_0", "event_2"), ("sally", "house", "event_2", "event_4"), ("sally", "garden", "event_4", "event_2_1"), ("sally", "red_basket", "event_2_1", None)} <= got


def test_who_observes_the_move(spark, story):
    keys = P.resolved_keys(spark.createDataFrame([("s", "sally", "section_1"), ("s", "anne", "section_1")], "story string, character string, section string"), story["nodes"])[0]
    got = P.knowledge(P.facts(story["nodes"], story["edges"]), keys).collect()
    seen = {c: {r["event"] for r in got if r["character"] == c} for c in ("sally", "anne")}
    assert seen == {"sally": {"event_0", "event_1", "event_2", "event_4"}, "anne": {"event_0"} - {"event_0"} | {"event_3"}}


def test_state_at_sections(spark, story):
    keys = spark.createDataFrame([("s", "marble", 0), ("s", "marble", 1)], "story string, entity string, n int")
    got = {(r["n"], r["target_id"]) for r in P.state_at(story["edges"], story["nodes"], keys).collect()}
    assert got == {(0, "blue_box"), (1, "blue_box")}  # the window of the basket ends in the section where it starts


def test_knowledge_only_grows(story):
    cube = P.knowledge(P.facts(story["nodes"], story["edges"]), P.all_keys(story["nodes"])).collect()
    at = lambda s: {(r["character"], r["id"]) for r in cube if r["section"] == s}
    assert at("section_1") <= at("section_2")
    assert all(r["pos"] <= r["cutoff"] for r in cube)


def test_windows_do_not_overlap_and_do_not_depend_on_order(spark, story):
    again = story["windows"].repartition(7)
    last = again.groupBy("from", "type").agg(F.sum(F.col("valid_until").isNull().cast("int")).alias("open")).collect()
    assert {r["open"] for r in last} == {1}


def test_story_documents(spark, story, tmp_path):
    for name, docs in {"full": ("meta", "lexical", "objective-graph"), "half": ("meta", "lexical")}.items():
        (tmp_path / name).mkdir()
        content = {
            "meta": {"slug": "other", "name": "N", "sourceFile": "f"},
            "lexical": {"granularity": "sentence", "sections": [{"id": "section_1", "index": 0, "title": "T", "wordCount": 3}], "nodes": [{"id": "sentence_1", "section": "section_1", "position": 0, "text": "a", "entities": []}]},
            "objective-graph": {"entities": [{"id": "a", "type": "character", "label": "A"}], "events": [], "stateEdges": []},
        }
        for d in docs:
            (tmp_path / name / f"{d}.json").write_text(json.dumps(content[d]))
    got = io.read_stories(spark, f"file://{tmp_path}")
    assert [r["story"] for r in got["stories"].collect()] == ["full"]
    assert got["entities"].count() == 1 and got["mentions"].count() == 0 and got["member_of"].count() == 0
    (tmp_path / "full" / "examples.json").write_text(json.dumps([{"id": "q", "character": "a", "section": "section_1", "question": "?", "expectedTheme": "t"}]))
    assert io.read_examples(spark, f"file://{tmp_path}").first()["expected_theme"] == "t"
    (tmp_path / "My_old story.md").write_text("text")
    assert io.read_texts(spark, f"file://{tmp_path}/*.md").first()[:2] == ("my-old-story", "My Old Story")


def test_results_lists_and_groups(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "story string, n int")
    io.write_results({"x": df}, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/x").count() == 2
    assert io.in_group(df, spark.createDataFrame([("a", "g")], "story string, group string"), "g").count() == 1
    assert io.pending_stories(df, df.filter("n = 1")).count() == 1


def test_answers(spark):
    raw = ['```json\n{"newEntities": [{"id": "a", "type": "", "client": "x"}, {"id": "c", "type": "case", "client": "x"}], "events": [{"id": "e", "participants": "odd"}]}\n```', "no json", "", None, '{"events": null, "clues": [{"object": "o"}]}']
    a = E.parsed(spark.createDataFrame([("s", f"section_{i}", i, r) for i, r in enumerate(raw)], "story string, section string, section_idx int, raw string"))
    assert [r["parse_ok"] for r in a.orderBy("section_idx").collect()] == [True, False, False, False, True] or a.filter("section_idx = 1 AND parse_ok").isEmpty()
    e = {r["id"]: r for r in E.new_entities(a).collect()}
    assert e["a"]["type"] == "object" and e["a"]["client"] is None and e["a"]["label"] == "a" and e["c"]["client"] == "x"
    assert E.clues(a).first()["source_nodes"] == []


def test_streamed_answers_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"story": "s", "section": f"section_{i}", "section_idx": i, "raw": "{}"}))
        ingest.ingest(ingest.answers(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/log", lambda df: seen.append([r["section"] for r in df.collect()])).awaitTermination()
    assert [x for x in seen if x] == [["section_0"], ["section_1"]]


def test_empty_graph(story):
    n, e = story["nodes"].limit(0), story["edges"].limit(0)
    assert P.facts(n, e).count() == 0 and P.events(n, e).count() == 0 and G.key_violations(n, e).count() == 0 and G.checked_edges(e, n)[0].count() == 0


def test_unknown_ids(spark, story):
    odd = story["windows"].limit(1).withColumn("valid_from", F.lit("nowhere")).withColumn("valid_until", F.lit("never"))
    r = G.windowed_edges(odd, G.event_positions(story["events"], story["sections"])).first()
    assert (r["valid_from_section"], r["valid_to_section"]) == (0, None)
    assert G.event_positions(story["events"].limit(1).withColumn("section", F.lit("nowhere")), story["sections"]).first()["pos"] == 0
