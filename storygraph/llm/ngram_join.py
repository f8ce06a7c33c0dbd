"""N-gram Jaccard join: a blocked sparse product of the incidence matrix of documents by n-grams with itself.

Rows are classes of documents with the same set of n-grams, columns are n-grams in the order of their hashes; the product counts what two
rows share. Only counts that reach the bounds set by the rows' sizes are wanted, so columns are taken in blocks:

1. The leading block. A row of n may have at most S = 15 n / 100 columns that a linked row has not, so of its first S + S / 3 + 1 columns
   it shares S / 3 + 1 with a linked row of its size, and K, S / 3 + 1 of the least size that may link, with any. Columns of one row alone
   are dropped; a row with fewer than K others has no link at all and leaves. Rows that stay are posted under their rarest columns of the
   block, all but K - 1.
2. Row blocks. A column's rows are dealt by size, so that only rows whose sizes allow a link meet, and each such list is multiplied with one
   row alone, its hub: n rows of near copies take n overlaps, not n * n. Overlaps are accumulated over the remaining columns, block by
   block, and a pair is discarded as soon as what is left cannot bring it to its bound. What reaches it is a link.
3. Hubs whose rows are still in different components: their rows are written as differences to the hub. The product of these rows, sparser
   than the first one, is taken over rare differences alone, as many as the bounds make necessary, and counted exactly for what meets.
   No link between rows of different components is lost; links inside a component are not needed.

Defined cases: a null or empty text, or one without words, has no n-grams and is linked with nothing; fewer words than WIDTH are one n-gram;
a row with a null doc_id is linked with nothing (component null); of rows that repeat a doc_id each is linked by its own text; an empty
table gives an empty result; other columns are ignored. N-grams are compared by 64-bit hashes, whole sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.llm.common import mix, stored
from storygraph.llm.components import components
from storygraph.llm.near_dedup import SIMILAR, difference_postings, differences, digest, meeting, shingles

WIDTH = 4
#: Columns of the remaining matrix are accumulated in so many blocks.
BLOCKS = 8
#: Rounds in which a list of differences meets one of its rows alone, at most; they only save work of the step after them.
ROUNDS = 3


def slack(n: int) -> int:
    """How many of its n columns a row may miss of a linked row."""
    return n * (100 - SIMILAR) // 100


def leading(n: int) -> int:
    """The number of columns of the leading block."""
    return slack(n) + slack(n) // 3 + 1


def _second(sets: np.ndarray) -> int:
    return int(mix(sets ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, node, check, lead) from (doc_id, text)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(x, WIDTH) for x in part.column(1).to_pylist()]
            leads = [s[: leading(len(s))] for s in sets]
            ends = np.cumsum([0] + [len(x) for x in leads]).astype(np.int32)
            made = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([digest(s) for s in sets], np.uint64).view(np.int64)),
                pa.array(np.array([_second(s) for s in sets], np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(leads).view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n_shingles", "node", "check", "lead"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) from (node, first, check, text); texts of another class, that have the same doc_id, are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            both = []
            for node, first, check, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                s = shingles(text, WIDTH)
                if np.uint64(digest(s)).astype(np.int64) == first and np.uint64(_second(s)).astype(np.int64) == check:
                    both.append((node, s))
            ends = np.cumsum([0] + [len(s) for _, s in both]).astype(np.int32)
            flat = np.concatenate([s for _, s in both]).view(np.int64) if both else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in both], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "set"])


def least_overlap(m: int, n: int) -> int:
    """The least c with 100 c >= SIMILAR (m + n - c)."""
    return -(-SIMILAR * (m + n) // (100 + SIMILAR))


def overlap(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """How many values the sorted sets a and b share, or -1 as soon as it cannot reach `least`. Accumulated over BLOCKS ranges of values."""
    if min(len(a), len(b)) < least:
        return -1
    edges = np.linspace(-(2.0**63), 2.0**63, BLOCKS + 1)[1:-1].astype(np.int64)
    i, j = ([0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (a, b))
    total = 0
    for k in range(BLOCKS):
        both = np.concatenate([a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]])
        both.sort()
        total += int((both[1:] == both[:-1]).sum())
        if total + min(len(a) - i[k + 1], len(b) - j[k + 1]) < least:
            return -1
    return total


def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the sets a and b are similar enough; sets come in the order of their unsigned values."""
    sets = ((np.sort(s), np.sort(t)) for s, t in zip(a, b, strict=True))
    return pd.Series([overlap(s, t, least_overlap(len(s), len(t))) >= 0 for s, t in sets], dtype="bool")


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(a, b, strict=True)], dtype="int64")


def classes_of(rows: DataFrame) -> DataFrame:
    """(node, first, check, n, doc, lead): a row for each set. node is its hash `first`, or, for sets that share it, one of both hashes."""
    real = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    twice = real.groupBy("node").agg(F.min("check").alias("_least"), F.max("check").alias("_most")).filter("_least != _most").drop("_most")
    made = real.groupBy("node", "check").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("lead").alias("lead"))
    other = F.col("_least").isNotNull() & (F.col("_least") != F.col("check"))
    out = made.join(twice, "node", "left").withColumn("first", F.col("node"))
    return out.withColumn("node", F.when(other, F.xxhash64("first", "check")).otherwise(F.col("first"))).drop("_least")


def postings(classes: DataFrame) -> DataFrame:
    """(column, size, node, common): the lists of step 2, stored. common: how common the columns are that the row was posted under."""
    n = F.col("n")
    # A third of what the smallest row that may link has on its own at most, and one: so many leading columns are shared.
    least = F.floor(F.floor(F.floor((SIMILAR * n + 99) / 100) * (100 - SIMILAR) / 100) / 3) + 1
    cells = classes.select("node", F.explode("lead").alias("column"))
    often = cells.groupBy("column").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = cells.join(often, "column").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rows", "column"))).alias("e"))  # a row's lead at most
    shared = shared.join(classes.select("node", "n"), "node").filter(F.size("e") >= least).select(
        "node",
        F.floor(F.log(n.cast("double")) / -np.log(0.84)).cast("int").alias("size"),  # sizes that allow a link differ by one step at most
        F.aggregate("e", F.lit(0.0), lambda s, x: s + F.log2(x["rows"])).alias("common"),
        F.slice("e", F.lit(1), (F.size("e") - least + 1).cast("int")).getField("column").alias("e"),  # rarest first
    )
    lists = stored(shared, "ngram-rows")
    return lists.select("node", "common", "size", F.explode("e").alias("column")).select("node", "common", "column", F.explode(F.array("size", F.col("size") + 1)).alias("size"))


def products(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links (u, v) that make the components of the classes."""
    lists = postings(classes)
    hubs = lists.groupBy("column", "size").agg(F.max(F.struct("common", "node")).alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = lists.select("column", "size", "node").join(hubs.select("column", "size", F.col("h.node").alias("hub")), ["column", "size"])
    pairs = stored(pairs.filter("node != hub").select("node", "hub").distinct(), "ngram-hubs")
    nodes = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    wanted = classes.select("node", "first", "check", F.col("doc").alias("doc_id")).join(nodes, "node")
    sets = docs.join(wanted, "doc_id").select("node", "first", "check", "text").mapInArrow(_sets, "node long, set array<long>")
    sets = stored(sets.dropDuplicates(["node"]), "ngram-sets", "snappy")
    linked = F.pandas_udf(_linked, "boolean")
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("set").alias("hub_set")), "hub")
    links = stored(both.filter(linked("set", "hub_set")).select(F.col("node").alias("u"), F.col("hub").alias("v")), "ngram-links")
    # Rows that their hub left in different components.
    at = pairs.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = at.groupBy("hub").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("hub")
    at = stored(at.join(mixed, "hub", "left_semi"), "ngram-rest")
    apart = stored(differences(at, sets), "ngram-differences", "snappy")
    posted, everything = difference_postings(apart, at.select("node", "root").distinct()), links
    for number in range(ROUNDS):
        key = ["hub", "low", "high", "x"]
        pivot = posted.groupBy(*key).agg(F.min(F.struct(F.xxhash64("node", F.lit(number)), F.col("node").alias("v"), F.col("root").alias("other"))).alias("p"))
        met = posted.join(pivot, key).filter("root != p.other").select("hub", F.greatest("node", "p.v").alias("u"), F.least("node", "p.v").alias("v")).distinct()
        more = stored(_counted(met, apart), "ngram-links")
        if more.isEmpty():
            break
        everything = everything.unionByName(more)
        posted = posted.drop("root").join(components(everything), "node", "left").withColumn("root", F.coalesce("root", "node"))
        posted = stored(posted, "ngram-differences", "snappy")
    return everything.unionByName(stored(_counted(meeting(posted), apart), "ngram-links"))


def _counted(met: DataFrame, apart: DataFrame) -> DataFrame:
    """The links among pairs (hub, u, v), by their differences to the hub."""
    common = F.pandas_udf(_common, "long")
    a = apart.select("hub", F.col("node").alias("u"), F.col("n").alias("m"), F.col("diff").alias("a"))
    b = apart.select("hub", F.col("node").alias("v"), "n", F.col("diff").alias("b"))
    both = stored(met, "ngram-pairs").join(a, ["hub", "u"]).join(b, ["hub", "v"])
    both = both.select("u", "v", "m", "n", (F.size("a") + F.size("b") - 2 * common("a", "b")).alias("_apart"))
    c = (F.col("m") + F.col("n") - F.col("_apart")) / 2
    return both.filter(100 * c >= SIMILAR * (F.col("m") + F.col("n") - c)).select("u", "v").distinct()


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = stored(docs.mapInArrow(_rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, node long, check long, lead array<long>"), "ngram-rows", "snappy")
    classes = stored(classes_of(rows), "ngram-classes", "snappy")
    roots = classes.select("node", "first", "check", "doc").join(components(products(classes, docs)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = stored(roots, "ngram-roots")
    least = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    labels = roots.join(least, "root").select(F.col("first").alias("node"), "check", "component_id")
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = rows.select("doc_id", "n_shingles", F.when(real, F.col("node")).alias("node"), "check").join(labels, ["node", "check"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB, on whole tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS size, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, size, i, string_agg(word, ' ') OVER r AS gram FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE i <= greatest(1, size - 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS hop FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.hop),
m AS (SELECT doc_id, min(hop) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""
