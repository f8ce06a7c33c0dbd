import pytest
from pyspark.sql import functions as F

from storygraph.sources.snapshots import GraphStore

NODE, EDGE = "story string, id string, name string", "story string, from_id string, to_id string, rel_type string"


def graph(spark, stories, mark):
    nodes = [(s, i, f"{mark} {s} {i}") for s in stories for i in ("a", "b")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame([(s, "a", "b", mark) for s in stories], EDGE)


def marks(store, version=None):
    """story -> marks of its nodes and edges."""
    g = store.read(version)
    n = g["nodes"].select("story", F.split("name", " ")[0].alias("m")).unionByName(g["edges"].select("story", F.col("rel_type").alias("m")))
    return {r["story"]: sorted(r["m"]) for r in n.groupBy("story").agg(F.collect_list("m").alias("m")).collect()}


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/graph")


def test_versions_replace_whole_stories(spark, store):
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.publish(*graph(spark, ["s1", "s2", "3"], "old")) == 1
    assert store.publish(*graph(spark, ["s2", "s4"], "new")) == 2
    want = {"s1": ["old"] * 3, "3": ["old"] * 3, "s2": ["new"] * 3, "s4": ["new"] * 3}
    assert marks(store) == want and marks(store, 1) == {s: ["old"] * 3 for s in ("s1", "s2", "3")}
    assert store.publish(*graph(spark, ["s2", "s4"], "new")) == 3 and marks(store) == want  # a rerun
    nothing = [df.filter("false") for df in graph(spark, ["x"], "x")]
    store.publish(*nothing, stories=spark.createDataFrame([("s1",)], "story string"))
    assert "s1" not in marks(store) and len(marks(store)) == 3


@pytest.mark.parametrize("dies", ["nodes", "edges", "list"])
def test_a_writer_that_dies_leaves_the_old_graph_whole(spark, store, monkeypatch, dies):
    store.publish(*graph(spark, ["s1", "s2"], "old"))
    write, rename = GraphStore._write, GraphStore._rename

    def failing(self, table, rows, batch):
        if table == dies:
            raise OSError("died")
        write(self, table, rows, batch)

    def unnamed(self, made, version):
        if dies == "list":
            raise OSError("died")
        return rename(self, made, version)

    with monkeypatch.context() as m:
        m.setattr(GraphStore, "_write", failing)
        m.setattr(GraphStore, "_rename", unnamed)
        with pytest.raises(OSError):
            store.publish(*graph(spark, ["s2", "s3"], "new"), batch="b7")
    assert store.version() == 1 and marks(store) == {"s1": ["old"] * 3, "s2": ["old"] * 3}
    assert store.publish(*graph(spark, ["s2", "s3"], "new"), batch="b7") == 2  # the rerun overwrites what was left
    assert marks(store) == {"s1": ["old"] * 3, "s2": ["new"] * 3, "s3": ["new"] * 3}


def test_a_named_batch_is_published_once(spark, store):
    assert store.publish(*graph(spark, ["s1"], "one"), batch="b1") == 1
    assert store.publish(*graph(spark, ["s1"], "two"), batch="b2") == 2
    assert store.publish(*graph(spark, ["s1"], "one"), batch="b1") == 1  # a replay changes nothing
    assert marks(store) == {"s1": ["two"] * 3}


def test_of_two_writers_none_is_lost(spark, store, monkeypatch):
    store.publish(*graph(spark, ["s1", "s2"], "old"))
    rename, other = GraphStore._rename, GraphStore(spark, store.root)

    def late(self, made, version):
        monkeypatch.setattr(GraphStore, "_rename", rename)
        assert other.publish(*graph(spark, ["s2"], "other")) == 2  # meanwhile
        return rename(self, made, version)

    monkeypatch.setattr(GraphStore, "_rename", late)
    assert store.publish(*graph(spark, ["s1"], "mine")) == 3
    assert marks(store) == {"s1": ["mine"] * 3, "s2": ["other"] * 3}


def test_vacuum_keeps_what_is_named(spark, store):
    for mark in ("a", "b", "c"):
        store.publish(*graph(spark, ["s1", mark], mark))
    store._write("nodes", graph(spark, ["s1"], "lost")[0], "lost")
    want = marks(store)
    store.vacuum(keep=2)
    assert marks(store) == want and store.versions() == [2, 3] and len(store._names("nodes")) == 3
    store.compact()
    store.vacuum()
    assert marks(store) == want and store.versions() == [4] and len(store._names("nodes")) == len(store._names("edges")) == 1
