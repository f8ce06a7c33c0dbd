"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks. A block keeps, for each dimension, its vectors in the order of that component. A query walks the lists of
its non-zero dimensions, downwards where its own component is positive and upwards where it is negative, some places at a time; each vector met for
the first time is scored in full. No vector that is still unmet can score more than the sum of the list heads times the query's
components; once that bound is below the k-th score, the block is done. Equal bounds go on, since ties go to the smaller id. The
best k of each block are merged in a window per query.

Queries are dealt into blocks too, and each meets each candidate block once: a query set against all rows, in blocks.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part; vectors of another length than a query's
aren't its candidates; of rows that repeat a vec_id each is a row of its own (a query's own row alone is left out), those of equal
score and id being ranked in any order; fewer than k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storygraph.llm.common import stored

TOP = 20
#: Rows of a candidate block and of a query block; places that a walk goes down before it looks at the bound, at first.
BLOCK, QUERIES, STEP = 8192, 512, 256


def search(lists: np.ndarray, values: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, skip: int, k: int) -> np.ndarray:
    """Places of the k best vectors, best first; skip: a place to leave out, or -1. lists[d]: places by rising component d."""
    up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
    n = len(ids)
    scores = np.zeros(n, vectors.dtype)
    met = np.zeros(n, bool)
    found = np.empty(0, np.int64)
    depth, step = 0, STEP
    while depth < n and len(up) + len(down):
        end = min(n, depth + step)
        mark = np.zeros(n, bool)
        mark[lists[up, depth:end].ravel()] = True
        mark[lists[down, n - end : n - depth].ravel()] = True
        new = np.flatnonzero(mark & ~met)
        met |= mark
        scores[new] = vectors[new] @ query
        found = np.concatenate([found, new[new != skip]])
        if len(found) > k:
            least = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= least]  # all that tie with the k-th
            found = found[np.lexsort((ids[found], -scores[found]))[:k]]
        depth, step = end, 2 * step
        if len(found) == k and depth < n:
            bound = values[up, depth - 1] @ query[up] + values[down, n - depth] @ query[down]
            if bound < scores[found].min():
                return found[np.lexsort((ids[found], -scores[found]))]
    if depth < n:  # a query of zeros: all scores are 0
        found = np.delete(np.arange(n), skip) if skip >= 0 else np.arange(n)
    return found[np.lexsort((ids[found], -scores[found]))[:k]]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, row, x): floor(64 * component) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(64 * c)).alias("x"))
    return rows.select("vec_id", F.monotonically_increasing_id().alias("row"), "x")


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """One row: ids, row numbers, vectors and sorted lists of a block."""
    vectors = np.array(table.column("x").to_pylist(), np.int64).reshape(table.num_rows, -1)
    lists = np.argsort(vectors, axis=0, kind="stable").T.astype("<i4") if vectors.size else np.empty((0, 0), "<i4")
    ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
    return pa.table(
        {
            "dim": pa.array([key[0].as_py()], pa.int32()),
            "block": pa.array([key[1].as_py()], pa.int64()),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "rows": pa.array([rows.astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([vectors.astype("<i8").tobytes()], pa.binary()),
            "lists": pa.array([np.ascontiguousarray(lists).tobytes()], pa.binary()),
        }
    )


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of about `size` rows with vectors of one length."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))  # a row for each length of vectors
    dealt = rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    return dealt.groupBy("dim", "block").applyInArrow(_block, "dim int, block long, ids binary, rows binary, vectors binary, lists binary")


def top(vectors: DataFrame, is_query, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of vectors for which is_query, a column, holds."""
    rows = stored(usable(vectors).withColumn("dim", F.size("x")), "vectors").filter(F.col("vec_id").isNotNull())
    candidates = stored(_blocks(rows, BLOCK), "vector-blocks")
    queries = _blocks(rows.filter(is_query), QUERIES)
    queries = queries.select("dim", F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "vectors")])
    # Each block of queries with each block of candidates of its dimension, by the numbers of the blocks, dealt over all tasks.
    blocks = candidates.groupBy("dim").agg(F.max("block").alias("last"))
    queries = queries.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = queries.join(candidates, ["dim", "block"]).repartition(parts, "dim", "block", "q_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids, own = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
                q_ids, q_rows = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_rows"], "<i8")
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1)
                asked = np.frombuffer(row["q_vectors"], "<i8").reshape(len(q_ids), -1)
                lists = np.frombuffer(row["lists"], "<i4").reshape(-1, len(ids))
                values = np.take_along_axis(vectors.T, lists, axis=1)
                largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(1, vectors.shape[1])
                kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64  # exact in each case
                vectors, asked, values = vectors.astype(kind), asked.astype(kind), values.astype(kind)
                place = {r: j for j, r in enumerate(own.tolist())}
                parts = [search(lists, values, vectors, ids, q, place.get(r, -1), k) for q, r in zip(asked, q_rows.tolist(), strict=True)]
                found = np.concatenate(parts) if parts else np.empty(0, np.int64)
                which = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                scores = np.einsum("ij,ij->i", vectors[found].astype(np.int64), asked[which].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[which], q_rows[which], ids[found], scores)], ["query_id", "row", "vec_id", "score"])

    best = met.mapInArrow(run, "query_id long, row long, vec_id long, score long")
    by = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


#: DuckDB, on whole tables.
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.x) = len(c.x)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
