"""Queries that read and write through the sources, over stories made from the given tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.operators import graph as G
from storygraph.operators import incremental
from storygraph.plans.sql import CONV, DOCS, MOVES, with_
from storygraph.sources import io
from storygraph.sources.projections import conversations, documents, moves
from storygraph.sources.snapshots import GraphStore
from storygraph.streaming import ingest, state


def _folder(spark: SparkSession) -> str:
    """A folder in spark.checkpoint.dir, which all executors share; a local one only where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="storygraph-")
    return f"{base}/sources-{uuid.uuid4().hex}"


def written_graph(spark: SparkSession, d: str) -> DataFrame:
    """Written twice, the second time for some stories alone, and read back."""
    c = conversations(spark, d)
    e = G.event_edges(c["events"]).select("story", "from_id", "to_id", "rel_type")
    path = _folder(spark)
    io.write_graph(e, path)
    io.write_graph(e.filter(F.col("story").endswith("3")).withColumn("rel_type", F.lower("rel_type")), path)
    return io.read_graph(spark, path).groupBy("story", "rel_type").agg(F.count(F.lit(1)).alias("n"))


def published_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges published together, some stories again with edges of another name, and a writer that died before its rename."""
    c = conversations(spark, d)
    nodes = c["events"].select("story", "id", "section").unionByName(c["entities"].select("story", "id", F.lit(None).cast("string").alias("section")))
    edges = G.event_edges(c["events"]).select("story", "from_id", "to_id", "rel_type")
    store, some = GraphStore(spark, _folder(spark)), F.col("story").endswith("3")
    store.publish(nodes, edges)
    store.publish(nodes.filter(some & F.col("section").isNotNull()), edges.filter(some).withColumn("rel_type", F.lower("rel_type")))
    store._write("nodes", nodes.filter(F.col("story").endswith("5")), "died")
    g = store.read()
    rows = g["nodes"].select("story", F.when(F.col("section").isNull(), "entity").otherwise("event").alias("kind")).unionByName(g["edges"].select("story", F.col("rel_type").alias("kind")))
    return rows.groupBy("story", "kind").agg(F.count(F.lit(1)).alias("n"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as text files, a folder for each source, and read back whole."""
    path = _folder(spark)
    t = documents(spark, d).filter("length(text) > 0")
    t.select("work", "text").write.partitionBy("work").option("lineSep", "\x00").text(path)
    back = spark.read.option("lineSep", "\x00").text(path)
    return back.groupBy("work").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("value")).alias("length"))


def streamed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that arrive as files, parsed by a stream that stops when it has read all."""
    path = _folder(spark)
    c = conversations(spark, d)
    blob = F.to_json(F.struct(F.array(F.struct("id", "label", "participants")).alias("events")))
    c["events"].select("story", "section", F.col("ord").alias("section_idx"), blob.alias("raw")).write.json(f"{path}/in")

    def write(batch: DataFrame) -> None:
        batch.select("story", "section", F.size("p.events").alias("events"), "parse_ok").write.mode("append").parquet(f"{path}/out")

    ingest.ingest(ingest.answers(spark, f"{path}/in", 4), f"{path}/log", write).awaitTermination()
    return spark.read.schema("story string, section string, events int, parse_ok boolean").parquet(f"{path}/out")


def merged_windows(spark: SparkSession, d: str) -> DataFrame:
    """The log of changes in three parts, of which the later ones fall between the earlier ones; each is merged into what is published."""
    changes = moves(spark, d)["state_changes"]
    store, part = GraphStore(spark, _folder(spark), ("windows",)), F.pmod(F.xxhash64("caused_by_event"), F.lit(3))
    for i in range(3):
        incremental.publish_changes(store, changes.filter(part == i), f"part-{i}")
        store.vacuum()  # nobody reads the part before
    return store.read()["windows"].select("story", "from", "to", "type", "valid_from", "valid_until")


def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """X9 as a stream: changes come as files, later days first, and are merged batch by batch."""
    path, changes = _folder(spark), moves(spark, d)["state_changes"]
    changes = changes.withColumn("ord", F.unix_micros(F.col("ord.ts").cast("timestamp"))).repartitionByRange(4, F.desc("section_idx"))
    changes.write.json(f"{path}/in")
    store = GraphStore(spark, f"{path}/out", ("windows",))
    stream = spark.readStream.schema(state.CHANGES).option("maxFilesPerTrigger", 2).json(f"{path}/in")
    state.stream_windows(stream, store, f"{path}/log").awaitTermination()
    return incremental.state_edges(store.read()["windows"]).select("story", "id", "from", "to", "type", "valid_from", "valid_until")


QUERIES = {"source_merged_windows": merged_windows, "source_streamed_windows": streamed_windows, "source_written_graph": written_graph, "source_published_graph": published_graph, "source_texts": texts, "source_streamed_answers": streamed_answers}
ORACLES = {
    "source_merged_windows": with_(MOVES) + 'SELECT story, "from", "to", type, valid_from, valid_until FROM m_edges',
    "source_streamed_windows": with_(MOVES)
    + """, g AS (SELECT *, min((section_idx, ts, event_id)) OVER (PARTITION BY story, "from", type) AS f FROM m_edges)
SELECT story, 'state_' || row_number() OVER (PARTITION BY story ORDER BY f, section_idx, ts, event_id) AS id, "from", "to", type, valid_from, valid_until FROM g""",
    "source_written_graph": with_(CONV)
    + """, e AS (SELECT story, 'PARTICIPATED_IN' AS rel_type FROM c_part UNION ALL SELECT story, 'PERFORMED' FROM c_events UNION ALL SELECT story, 'SPOKE_IN' FROM c_events UNION ALL SELECT story, 'TOLD_TO' FROM c_told)
SELECT story, CASE WHEN story LIKE '%3' THEN lower(rel_type) ELSE rel_type END AS rel_type, count(*) AS n FROM e GROUP BY 1, 2""",
    "source_published_graph": with_(CONV)
    + """, e AS (SELECT story, 'PARTICIPATED_IN' AS kind FROM c_part UNION ALL SELECT story, 'PERFORMED' FROM c_events UNION ALL SELECT story, 'SPOKE_IN' FROM c_events UNION ALL SELECT story, 'TOLD_TO' FROM c_told),
k AS (SELECT story, CASE WHEN story LIKE '%3' THEN lower(kind) ELSE kind END AS kind FROM e UNION ALL SELECT story, 'event' FROM c_events
      UNION ALL SELECT story, 'entity' FROM c_entities WHERE story NOT LIKE '%3')
SELECT story, kind, count(*) AS n FROM k GROUP BY 1, 2""",
    "source_texts": with_(DOCS) + "SELECT work, count(*) AS texts, sum(length(text))::BIGINT AS length FROM d_raw WHERE length(text) > 0 GROUP BY 1",
    "source_streamed_answers": with_(CONV) + "SELECT story, section, 1 AS events, true AS parse_ok FROM c_events",
}
