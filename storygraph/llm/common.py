"""Helpers that the operators of this subpackage share: scratch tables, word hashing, keys of rows, two-level prefix sums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that parts words: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tables and folders made by this driver and not dropped yet.
_made_tables: list[str] = []
_made_paths: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is set, a folder of our own if Spark runs in this
    process alone (tests); on a cluster, whose executors could not read it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="storygraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made_paths.append(path)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage.

    The files are replicated by the shared store, so a lost executor costs no recomputation of what led to them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int | None = None, sort: bool = False, part: str | None = None) -> str:
    """Writes df as a table of the catalog, bucketed by keys (and sorted by them, and partitioned by part), and returns its name."""
    spark = df.sparkSession
    table = f"storygraph_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd")
    writer = writer.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    writer = writer.sortBy(*keys) if sort else writer
    (writer.partitionBy(part) if part else writer).saveAsTable(table)
    _made_tables.append(table)
    return table


def drop_tables(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if name in _made_tables:
            _made_tables.remove(name)


def clear_scratch(spark: SparkSession) -> None:
    """Drops the intermediate tables and folders of all operators used so far. Call it once their results are written."""
    drop_tables(spark, list(_made_tables))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _made_paths:
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made_paths.clear()


def wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and _doc with all columns, so that names of our own meet none of theirs."""
    return docs.select(*names, F.struct(*docs.columns).alias("_doc"))


def unwrapped(df: DataFrame, columns: list[str], *made: str) -> DataFrame:
    """The columns of _doc in their order, `made` ones in place of those of their names or after them."""
    own = [F.col(c) if c in made else F.col("_doc").getField(c).alias(c) for c in columns]
    return df.select(*own, *[c for c in made if c not in columns])


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the runs of other characters than white space; empty for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as a long, 0 for a null."""
    return F.size(words(text)).cast("long")


def once(value: Column, body) -> Column:
    """body(value) where value is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the earlier rows of the same keys, in the order (chunk, *order).

    Two levels, so that no task orders all rows of a hot key: rows are summed within (keys, chunk), and only the chunks' sums are
    added up per key. chunk is a column with a bounded number of values per key.
    """
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, chunk, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    return (
        df.join(sums, [*keys, chunk])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_before")
    )


# What follows runs inside tasks, on the arrays of one batch.


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, split: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, split), np.uint64, len(split))


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of `width` neighbours of h, in order; empty when h is shorter."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    for i in range(width):
        out = mix(out * factor + h[i : i + n]) if i % 4 == 3 else out * factor + h[i : i + n]
    return mix(out)
