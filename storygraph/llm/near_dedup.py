"""MinHash near-dedup by a signature-coordinate inverted join.

1. Documents with the same set of shingles are one class. A class has a signature of K min-hashes; coordinate k and its shingle make one
   64-bit element.
2. Classes are posted under each of their elements. A pair that agrees in at least MATCH of K elements shares one of the K - MATCH + 1
   rarest elements of either (prefix filtering with one global order, rarest first), so only these lists are merged. Elements of one
   class alone take their places in the prefix and are skipped.
3. Each list proposes its hub, the member whose elements are the most common ones, to all its members; pairs with MATCH collisions are
   confirmed on full shingle sets, and confirmed links joined to components. So a group of n copies takes n comparisons, not n * n.
4. A hub whose members are still in different components lets them meet each other by their differences to its full set, the shingles
   that only one of both has. With d(A) and d(B) of these and c in common, the sets of A and B differ in d(A) + d(B) - 2 c shingles, so
   c decides a link exactly. Two members that need no difference in common are both linked with the hub (its own difference is empty),
   by step 3. All others must share at least (e(A) + e(B)) / 2 differences, e being d - 3/37 of the set's size: members are posted under
   the rarest of their differences, as many as partners of each class of e make necessary, and differences that no other member has are
   skipped. No partner is dropped; what is compared is what shares a rare difference.

A pair of similarity 0.85 has fewer than MATCH = 64 of K = 96 collisions about 4 times in a million.

Defined cases: a null or empty text has no shingles and is linked with nothing; a text of fewer words than a shingle is one shingle;
rows with a null doc_id are linked with nothing (component null, kept); of rows that repeat a doc_id each is linked by its own text;
an empty table gives an empty result. `kept` leaves one row of each group: a row goes only if one of the same group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storygraph.llm.common import WordHashes, mix, rolling, stored
from storygraph.llm.components import components

SHINGLE = 5
K, MATCH = 96, 64
SIMILAR = 85
#: A link's sets differ in at most SLACK / WHOLE of the sum of their sizes: 100 c >= 85 u, with c in common and u in either.
SLACK, WHOLE = 3, 37
#: Classes of e for the sizes of a hub's members; the fewest differences that one spans.
LEVELS, NARROWEST = 32, 2

_own: dict = {}


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles, as 64-bit hashes."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space alone
    if not ws:
        return np.empty(0, np.uint64)
    h = _own.setdefault("words", WordHashes()).of(ws)
    return np.unique(rolling(h, min(width, len(h)), seed=7))


def digest(sets: np.ndarray) -> int:
    """One number for a sorted set; 0 for the empty one."""
    return int(mix(sets).sum(dtype=np.uint64) ^ mix(np.uint64(len(sets)) + sets[:1])[0]) if len(sets) else 0


def signature(sets: np.ndarray, k: int = K) -> np.ndarray:
    """k elements: for each coordinate the shingle that its permutation of 32-bit values puts first, mixed with the coordinate."""
    made = _own.get(("factors", k))
    if made is None:
        wide = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        made = _own["factors", k] = (wide >> np.uint64(32)).astype(np.uint32) | np.uint32(1), wide
    factors, names = made
    least, first = np.full(k, np.iinfo(np.uint32).max, np.uint32), np.zeros(k, np.int64)
    high = (sets >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(sets), 512):
        h = factors[:, None] * high[None, at : at + 512]
        h ^= h >> np.uint32(15)
        i = h.argmin(axis=1)
        value = h[np.arange(k), i]
        better = value < least
        least[better], first[better] = value[better], at + i[better]
    return mix(sets[first] + names)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_shingles, node (the class) and sig (null without shingles) to rows whose last column is a text, which goes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(x) for x in part.column(part.num_columns - 1).to_pylist()]
            sigs = [signature(s) for s in sets if len(s)]
            ends = np.cumsum([0] + [K if len(s) else 0 for s in sets]).astype(np.int32)
            flat = np.concatenate(sigs).view(np.int64) if sigs else np.empty(0, np.int64)
            made = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([digest(s) for s in sets], np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], "n_shingles", "node", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) from (node, text); texts of another class, that have the same doc_id, are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            both = [(n, s) for n, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for s in [shingles(x)] if np.uint64(digest(s)).astype(np.int64) == n]
            ends = np.cumsum([0] + [len(s) for _, s in both]).astype(np.int32)
            flat = np.concatenate([s for _, s in both]).view(np.int64) if both else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in both], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "set"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The arrays of a list column, without copying them."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hub, n, diff) from (node, hub, set, hub_set): the size of the node's set, and what only one of both sets has, sorted."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            own = _lists(part.column(2))
            diffs = [np.setxor1d(a, b, assume_unique=True) for a, b in zip(own, _lists(part.column(3)), strict=True)]
            ends = np.cumsum([0] + [len(d) for d in diffs]).astype(np.int32)
            made = [pa.array([len(a) for a in own], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(diffs)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["node", "hub", "n", "diff"])


def _collisions(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    return pd.Series((np.stack(a.to_numpy()) == np.stack(b.to_numpy())).sum(axis=1).astype("int32"))


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many values the sets a and b share."""
    out = []
    for s, t in zip(a, b, strict=True):
        both = np.concatenate([s, t])
        both.sort()
        out.append(int((both[1:] == both[:-1]).sum()))
    return pd.Series(out, dtype="int64")


def _close(common: Column, m: Column, n: Column) -> Column:
    return 100 * common >= SIMILAR * (m + n - common)


def _rows(docs: DataFrame, *keys: Column) -> DataFrame:
    """In the shared folder, for each row of docs: doc_id, the keys, n_shingles, node and sig."""
    chosen = docs.select("doc_id", *keys, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    return stored(chosen.mapInArrow(_signed, f"{schema}, n_shingles long, node long, sig array<long>"), "near-rows")


def _prefixes(classes: DataFrame) -> DataFrame:
    """(node, common, element): a row for each list that a class is posted to. common: how common its elements are."""
    posted = classes.select("node", F.explode("sig").alias("element"))
    sizes = posted.groupBy("element").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = posted.join(sizes, "element").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("size", "element"))).alias("e"))  # K at most
    shared = shared.filter(F.size("e") >= MATCH).select(
        "node",
        F.aggregate("e", F.lit(0.0), lambda s, x: s + F.log2(x["size"])).alias("common"),
        F.slice("e", 1, F.size("e") - (MATCH - 1)).getField("element").alias("e"),  # rarest first
    )
    return stored(shared, "near-prefixes").select("node", "common", F.explode("e").alias("element"))


def _full_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, set) of all classes in pairs (node, hub), stored."""
    nodes = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    wanted = nodes.join(classes.select("node", F.col("doc").alias("doc_id")), "node")
    made = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "text").mapInArrow(_sets, "node long, set array<long>")
    return stored(made.dropDuplicates(["node"]), "near-sets")


def _hub_links(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (node, hub) with MATCH collisions whose full sets are similar, as (u, v)."""
    collisions, common = F.pandas_udf(_collisions, "int"), F.pandas_udf(_common, "long")
    own, hubs = classes.select("node", "sig"), classes.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig"))
    near = pairs.join(own, "node").join(hubs, "hub").filter(collisions("sig", "hub_sig") >= MATCH).select("node", "hub")
    near = stored(near, "near-pairs")
    both = near.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("set").alias("hub_set")), "hub")
    both = both.select("node", "hub", F.size("set").alias("m"), F.size("hub_set").alias("n"), common("set", "hub_set").alias("c"))
    return both.filter(_close(F.col("c"), F.col("m"), F.col("n"))).select(F.col("node").alias("u"), F.col("hub").alias("v"))


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, hub, n, diff) for pairs (node, hub): the node's size and its difference to the hub's full set."""
    both = pairs.select("node", "hub").join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("set").alias("hub_set")), "hub")
    return both.select("node", "hub", "set", "hub_set").mapInArrow(_apart, "node long, hub long, n long, diff array<long>")


def difference_postings(apart: DataFrame, roots: DataFrame) -> DataFrame:
    """(hub, node, root, low, high, is_low, is_high, x), stored: the lists (hub, low, high, x) of differences in which members of a hub meet that
    may share enough of them. apart: differences(); roots: (node, root)."""
    counts = apart.select("hub", F.explode("diff").alias("x")).groupBy("hub", "x").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    each = apart.select("node", "hub", F.explode("diff").alias("x")).join(counts, ["hub", "x"])
    shared = each.groupBy("node", "hub").agg(F.sort_array(F.collect_list(F.struct("size", "x"))).getField("x").alias("shared"))  # its own differences at most
    widest = apart.groupBy("hub").agg(F.greatest(F.lit(NARROWEST), F.ceil(F.max("n") / LEVELS)).alias("_w"))
    made = apart.select("node", "hub", "n", F.size("diff").cast("long").alias("d")).join(shared, ["node", "hub"]).join(widest, "hub").join(roots, "node")
    made = made.withColumn("_e", WHOLE * F.col("d") - SLACK * F.col("n")).withColumn("_w", WHOLE * F.col("_w"))  # in 1/37
    made = made.withColumn("own", F.floor(F.col("_e") / F.col("_w")))
    # A link shares no more differences than either has, so e(B) lies between e(A) - 6/37 of B's size, A's / 0.85 at most, and e(A) + 6/37 of A's.
    reach = 2 * SLACK * F.col("n")
    low, high = F.floor((F.col("_e") - F.ceil(reach * 100 / SIMILAR)) / F.col("_w")), F.floor((F.col("_e") + reach) / F.col("_w"))
    made = made.withColumn("other", F.explode(F.sequence(low, high)))
    needed = F.greatest(F.lit(1), F.ceil((F.col("_e") + F.col("other") * F.col("_w")) / (2 * WHOLE)))
    prefix = F.size("shared") - needed + 1  # of the d - needed + 1 rarest the first are those that no other member has
    posted = made.select(
        "hub", "node", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") <= F.col("other")).alias("is_low"), (F.col("own") >= F.col("other")).alias("is_high"),
        F.explode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), prefix).cast("int"))).alias("x"),
    )
    return stored(posted, "near-differences")


def meeting(posted: DataFrame) -> DataFrame:
    """(hub, u, v): the pairs of different components that meet in a list of difference_postings()."""
    key = ["hub", "low", "high", "x"]
    x = posted.filter("is_low").select(*key, F.col("node").alias("u"), F.col("root").alias("_ru"))
    y = posted.filter("is_high").select(*key, F.col("node").alias("v"), F.col("root").alias("_rv"))
    met = x.join(y, key).filter((F.col("_ru") != F.col("_rv")) & ((F.col("low") < F.col("high")) | (F.col("u") < F.col("v"))))
    return met.select("hub", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def candidates(apart: DataFrame, roots: DataFrame) -> DataFrame:
    """(hub, u, v): the pairs of a hub's members in different components that may share enough differences. apart: differences();
    roots: (node, root)."""
    return meeting(difference_postings(apart, roots))


def _further_links(pairs: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links (u, v) between members of a hub that the hub's own links have left in different components."""
    at = pairs.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = at.groupBy("hub").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("hub")
    at = stored(at.join(mixed, "hub", "left_semi"), "near-rest")
    apart = stored(differences(at, sets), "near-apart")
    met = stored(candidates(apart, at.select("node", "root").distinct()), "near-rest-pairs")
    common = F.pandas_udf(_common, "long")
    a = apart.select("hub", F.col("node").alias("u"), F.col("n").alias("m"), F.col("diff").alias("a"))
    b = apart.select("hub", F.col("node").alias("v"), "n", F.col("diff").alias("b"))
    both = met.join(a, ["hub", "u"]).join(b, ["hub", "v"])
    both = both.select("u", "v", "m", "n", (F.size("a") + F.size("b") - 2 * common("a", "b")).alias("_apart"))
    return both.filter(_close((F.col("m") + F.col("n") - F.col("_apart")) / 2, F.col("m"), F.col("n"))).select("u", "v").distinct()


def grouped(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root, component_id): the component of each class, and the least doc_id in it. rows: _rows(docs)."""
    classes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    classes = stored(classes, "near-classes")
    prefix = _prefixes(classes)
    hubs = prefix.groupBy("element").agg(F.max(F.struct("common", "node")).alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = prefix.select("element", "node").join(hubs.select("element", F.col("h.node").alias("hub")), "element")
    pairs = stored(pairs.filter("node != hub").select("node", "hub").distinct(), "near-hubs")
    sets = _full_sets(docs, classes, pairs)
    links = stored(_hub_links(pairs, classes, sets), "near-links")
    more = stored(_further_links(pairs, sets, components(links)), "near-links")
    found = components(links.unionByName(more))
    roots = classes.select("node", "doc").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    return stored(roots.join(least, "root").select("node", "root", "component_id"), "near-labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = rows.drop("sig").withColumn("node", F.when(real, F.col("node"))).join(labels, "node", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = _rows(docs)
    out = _labelled(rows, grouped(docs, rows))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64("text", "doc_id", F.lit("row")).alias("_k2")]


def kept(docs: DataFrame) -> DataFrame:
    """docs without the copies: of each group the row of least doc_id stays, and of rows with that doc_id the one of least key; rows
    without a doc_id or without a word all stay. Of rows alike in doc_id and text, the one whose other columns sort first stays."""
    keys, names = _row_keys(), ["_k1", "_k2"]
    rows = _rows(docs.select("doc_id", "text"), *keys)
    labels = grouped(docs.select("doc_id", "text"), rows)
    real = _labelled(rows, labels).filter(F.col("root").isNotNull())
    chosen = real.groupBy("root").agg(F.min(F.struct("doc_id", *names)).alias("c")).select("c._k1", "c._k2")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"), first.alias("_first"), *keys)
    single = whole["doc_id"].isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = whole.filter(~single).join(chosen, names, "left_semi")
    stay = stay.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy("_first"))).filter("_nth = 1")
    return stay.select("_doc.*").unionByName(whole.filter(single).select("_doc.*"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB, on whole tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS size, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, size, i, string_agg(word, ' ') OVER r AS gram FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE i <= greatest(1, size - 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS hop FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.hop),
m AS (SELECT doc_id, min(hop) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
