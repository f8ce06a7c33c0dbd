import random

import pytest
from pyspark.sql import functions as F

from storygraph.operators import incremental as N
from storygraph.operators import objective as O
from storygraph.sources.snapshots import GraphStore
from storygraph.streaming import state as S

CHANGE = "story string, section_idx int, ord long, `from` string, to string, type string, caused_by_event string"


def log(seed, n=120):
    """Changes of three stories; many of one key in one section."""
    rnd = random.Random(seed)
    places = rnd.sample([(s, o) for s in range(12) for o in range(40)], n)
    return [(rnd.choice("aab"), s, o, rnd.choice(["x", "x", "y"]), f"place {rnd.randrange(5)}", rnd.choice(["IS_INSIDE", "OWNS"]), f"e{s}_{o}") for s, o in places] + [("c", 3, 1, "z", "box", "OWNS", "c1")]


def edges(df):
    return sorted(tuple(r) for r in df.select("story", "id", "from", "to", "type", "valid_from", "valid_until").collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_parts_in_any_order_equal_one_batch(spark, seed):
    rows = log(seed)
    want = edges(O.state_windows(spark.createDataFrame(rows, CHANGE)))
    random.Random(seed).shuffle(rows)
    parts = [spark.createDataFrame(rows[i::3], CHANGE) for i in range(3)]
    got = N.windows(parts[0])
    for part in (parts[1], parts[1], parts[2]):  # one of them twice
        got = spark.createDataFrame(N.applied(got, part).collect(), got.schema)
    assert edges(N.state_edges(got)) == want


def test_only_neighbours_change(spark):
    rows = [("a", s, 0, "x", f"p{s}", "OWNS", f"e{s}") for s in range(50)]
    old = N.windows(spark.createDataFrame(rows, CHANGE))
    late = spark.createDataFrame([("a", 20, 5, "x", "q", "OWNS", "late"), ("a", 20, 3, "x", "r", "OWNS", "later"), ("a", -1, 0, "x", "s", "OWNS", "before"), ("a", 0, 0, "new", "t", "OWNS", "first")], CHANGE)
    made, gone = N.merged(old, late)
    got = sorted((r["valid_from"], r["valid_until"]) for r in made.collect())
    assert got == [("before", "e0"), ("e20", "later"), ("first", None), ("late", "e21"), ("later", "late")]
    assert [tuple(r["at"]) for r in gone.collect()] == [(20, 0)]


def test_untouched_stories_keep_their_files(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/w", ("windows",))
    rows = log(4)
    early = [r for r in rows if r[0] == "c" or r[2] % 2]
    N.publish_changes(store, spark.createDataFrame(early, CHANGE), "one")
    before = {r["story"]: r["batch"] for r in store.stories().collect()}
    late = [r for r in rows if r not in early]
    N.publish_changes(store, spark.createDataFrame(late, CHANGE), "two")
    after = {r["story"]: r["batch"] for r in store.stories().collect()}
    assert before["c"] == after["c"] == "one" and after["a"] == after["b"] == "two"
    assert edges(N.state_edges(store.read()["windows"])) == edges(O.state_windows(spark.createDataFrame(rows, CHANGE)))
    assert N.publish_changes(store, spark.createDataFrame(late, CHANGE), "two") == 2 == store.version()


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_changes_in_any_order(spark, tmp_path, seed):
    rows = log(seed)
    random.Random(seed).shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], CHANGE).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    store = GraphStore(spark, f"file://{tmp_path}/w", ("windows",))
    stream = spark.readStream.schema(S.CHANGES).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    S.stream_windows(stream, store, f"{tmp_path}/log").awaitTermination()
    assert store.version() == 3
    assert edges(N.state_edges(store.read()["windows"])) == edges(O.state_windows(spark.createDataFrame(rows, CHANGE)))


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_registry_in_any_order(spark, tmp_path, seed):
    rnd = random.Random(seed)
    places = rnd.sample([(s, p, o) for s in range(6) for p in range(3) for o in range(5)], 60)
    rows = [(rnd.choice("ab"), f"id{rnd.randrange(9)}", "object", f"label {p}", *p, f"2024-01-01T00:{i:02d}:00Z") for i, p in enumerate(places)]
    rows.append(("a", "", "object", "no id", 0, 0, 0, "2024-01-01T00:00:00Z"))
    schema = S.DEFINITIONS.replace("seen timestamp", "seen string")
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(S.DEFINITIONS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")

    def write(df, number):
        df.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{tmp_path}/out")

    S.registry(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    emitted = spark.read.parquet(f"{tmp_path}/out")
    best = {}
    for story, i, kind, label, s, p, o, _ in rows:
        if i:
            best[story, i] = min(best.get((story, i), ((9,), None)), ((s, p, o), (kind, label, s, p > 0)))
    got = {(r["story"], r["id"]): (r["type"], r["label"], r["first_idx"], r["stub"]) for r in S.latest(emitted).collect()}
    assert got == {k: v for k, (_, v) in best.items()}
    assert emitted.count() > len(got) and emitted.select("batch").distinct().count() == 3  # some were corrected


def test_windows_are_shuffled_once(spark, tmp_path):
    """Merging and linking need one shuffle of the windows; stories that a change touches are met without one. Rows that are there stay."""
    rows = log(7)
    old = N.windows(spark.createDataFrame(rows[::2], CHANGE))
    path = f"file://{tmp_path}/old"
    old.write.parquet(path)
    new = N.applied(spark.read.schema(old.schema).parquet(path), spark.createDataFrame(rows[1::2], CHANGE))
    assert new._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    again = [(*r[:4], "elsewhere", *r[5:]) for r in rows]
    store = GraphStore(spark, f"file://{tmp_path}/w", ("windows",))
    for part in (rows[1::2], rows[::2], again):
        N.publish_changes(store, spark.createDataFrame(part, CHANGE))
        store.vacuum()
    assert edges(N.state_edges(store.read()["windows"])) == edges(O.state_windows(spark.createDataFrame(rows, CHANGE))) == edges(N.state_edges(new))
    assert len(store.versions()) == 1 and len(store._names("windows")) == 1
