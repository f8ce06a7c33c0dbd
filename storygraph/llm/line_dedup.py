"""Line dedup: levelled sorted runs of line hashes, compacted now and then; each batch merge-anti-joins the runs and adds its own.

A line's key is the line without white space at its ends, A-Z lower-cased, known by a 128-bit hash. Documents come in batches. A batch's
hashes, with the number of its documents that hold each, are merge-joined with all runs, which splits them in two: what no run holds (the
anti-join) is new and becomes a run of level 0; what some run holds goes, with its numbers, to the counts. Both are written at once. FANOUT runs of a level are merged into one of the next, so a hash is
rewritten only log(batches) times, and no hash is in two runs. Runs are tables bucketed and sorted by hash, so that joins with them move
and sort the other side alone. A key's documents are its number in its run and its numbers in the counts: only keys that more than one
batch holds have to be added up. Keys that enough documents hold lose all their lines; the others stay.

The number of batches grows with the logarithm of the table: FANOUT + 1, and one more for each doubling beyond UNIT.

Defined cases: a null or empty text is one empty line; empty keys are never dropped; rows that repeat count as documents of their
own; documents with a null doc_id are cleaned like the others; an empty table gives an empty result; other columns are ignored
by the query and kept by `clean`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.llm.common import SPACE, ascii_lower, bucketed, drop_tables, once, scratch_path, stored, unwrapped, wrapped

FANOUT = 4
#: Bytes of texts up to which there are FANOUT + 1 batches.
UNIT = 1 << 30
MIN_DOCS = 10
SALTS = 16


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def batches_for(size: int) -> int:
    """The number of batches for `size` bytes of texts."""
    return FANOUT + 1 + math.ceil(math.log2(max(1.0, size / UNIT)))


def row_key() -> list[Column]:
    """Columns that only rows with the same doc_id and text share; these have the same result."""
    body = F.coalesce("text", F.lit(""))
    return [F.xxhash64("doc_id", body).alias("k1"), F.xxhash64(body, "doc_id", F.lit("row")).alias("k2")]


def line_places(text: Column) -> Column:
    """array of (h1, h2, at) (h2 hashes the key under another seed, so it is no function of h1): the distinct hashes of a text's non-empty keys, and the places of the lines that have it.

    Sorted by hash, so that equal ones are neighbours: a text of n lines takes n log n steps.
    """

    def placed(line: Column, i: Column) -> Column:
        return once(line_key(line), lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2"), i.alias("i"))))

    def groups(each: Column) -> Column:
        other = lambda x, i: (i == 0) | (F.get(each, i - 1)["h1"] != x["h1"]) | (F.get(each, i - 1)["h2"] != x["h2"])
        starts = F.filter(F.transform(each, lambda x, i: F.when(other(x, i), i)), lambda i: i.isNotNull())

        def group(starts: Column) -> Column:
            end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(each))
            own = lambda i, j: F.transform(F.slice(each, i + 1, end(j) - i), lambda x: x["i"])
            return F.transform(starts, lambda i, j: F.struct(F.get(each, i)["h1"].alias("h1"), F.get(each, i)["h2"].alias("h2"), own(i, j).alias("at")))

        return once(starts, group)

    full = F.filter(F.transform(lines(text), placed), lambda x: x.isNotNull())
    return once(F.sort_array(full), groups)


def document_lines(docs: DataFrame, batches: int) -> DataFrame:
    """(batch, k1, k2, h1, h2, at): the distinct line hashes of each document, with their places, dealt into batches by document."""
    each = docs.select(*row_key(), F.explode(line_places(F.col("text"))).alias("h"))
    return each.select("k1", "k2", "h.h1", "h.h2", "h.at", F.pmod("k1", F.lit(batches)).cast("int").alias("batch"))


class LineStore:
    """Levelled runs (h1, h2, n_docs), each a table of its own. The driver holds only the tables' names."""

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.batches: list[str] = []
        self.merged: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        return bucketed(rows.select(*self.KEY, "n_docs", "known"), "lines", self.KEY, sort=True, part="known")

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("NOT known").drop("known")

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            rows = self.run(full[0])
            for other in full[1:]:
                rows = rows.unionByName(self.run(other))
            self.merged.append(self._write(rows.repartition(*self.KEY).withColumn("known", F.lit(False))))
            self._push(self.merged[-1], level + 1)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def split(self, batch: DataFrame) -> DataFrame:
        """A batch with `known`: whether a run holds the hash. One merge join with each run, whose side is neither shuffled nor collected."""
        known = F.lit(False)
        for i, name in enumerate(self.runs()):
            batch = batch.join(self.run(name).select(*self.KEY, F.lit(True).alias(f"_in{i}")).hint("merge"), list(self.KEY), "left")
            known |= F.coalesce(F.col(f"_in{i}"), F.lit(False))
        return batch.withColumn("known", known).drop(*[f"_in{i}" for i in range(len(self.runs()))])

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose hash no run holds."""
        return self.split(batch).filter("NOT known").drop("known")

    def add(self, batch: DataFrame) -> None:
        """Adds a batch (h1, h2), a row for each document that holds the line: new hashes as a run, numbers of known ones as counts."""
        name = self._write(self.split(batch.groupBy(*self.KEY).agg(F.count(F.lit(1)).alias("n_docs"))))
        self.batches.append(name)
        self._push(name, 0)

    def frequent(self, min_docs: int) -> DataFrame:
        """Hashes that at least min_docs documents of all batches hold."""
        out = more = self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")
        for name in self.batches:
            more = more.unionByName(self.spark.table(name).filter("known").drop("known"))
        more = stored(more.groupBy(*self.KEY).agg(F.sum("n_docs").alias("_more")), "line-counts")
        for name in self.runs():
            held = self.run(name).join(more, list(self.KEY), "left")
            out = out.unionByName(held.select(*self.KEY, (F.col("n_docs") + F.coalesce("_more", F.lit(0))).alias("n_docs")))
        return out.filter(F.col("n_docs") >= min_docs).select(*self.KEY)

    def drop(self) -> None:
        drop_tables(self.spark, self.batches + self.merged)
        self.levels, self.batches, self.merged = [], [], []


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """All columns of docs, with text cleaned, and n_lines, n_dropped."""
    spark, columns = docs.sparkSession, docs.columns
    docs = wrapped(docs, "doc_id", "text")
    if batches is None:
        batches = batches_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    store = LineStore(spark, fanout)
    path = scratch_path(spark, "document-lines")
    document_lines(docs, batches).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    seen = spark.read.schema("k1 long, k2 long, h1 long, h2 long, at array<int>, batch int").parquet(path)
    for b in range(batches):
        store.add(seen.filter(F.col("batch") == b).select("h1", "h2"))
    frequent = stored(store.frequent(min_docs), "frequent-lines")
    store.drop()
    # Each document learns the places of its lines that go. A line that a third of all documents hold is spread over SALTS tasks by document.
    frequent = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = (
        seen.withColumn("salt", F.pmod("k2", F.lit(SALTS)).cast("int"))
        .join(frequent, ["h1", "h2", "salt"], "left_semi")
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_set("at")).alias("_gone"))  # no more than a document has lines
    )
    keyed = docs.select("*", *[c.alias(f"_{n}") for c, n in zip(row_key(), ("k1", "k2"), strict=True)])
    joined = keyed.join(gone, (F.col("_k1") == gone.k1) & (F.col("_k2") == gone.k2), "left").drop("k1", "k2", "_k1", "_k2")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = joined.withColumn("_lines", lines(F.col("text")))
    kept = kept.withColumn("_stay", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i))))
    n = F.size("_lines").cast("long")
    out = kept.withColumn("n_lines", n).withColumn("n_dropped", n - F.size("_stay"))
    return unwrapped(out.withColumn("text", F.array_join("_stay", "\n")), columns, "text", "n_lines", "n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB, on whole tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
