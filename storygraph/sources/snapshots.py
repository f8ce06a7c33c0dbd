"""S4, atomically: a graph's nodes and edges as versions of which a reader sees one whole.

    <root>/nodes/batch=<batch>/..., <root>/edges/batch=<batch>/...    rows, written once and never changed
    <root>/versions/v0000000007/...                                   (story, batch): which batch holds each story

A batch of stories is written beside what is there, nodes and edges both, then the next version's list of stories, and one rename of that
list to its number publishes all of it. A rename never replaces a version, so of two writers the second finds the number taken, joins its
stories to the other's version and takes the next number. What dies before its rename leaves rows that no version names.
Reruns write the same stories again, or, with the same `batch`, find it published and do nothing.

A version lists all stories, a row each; its batches are pruned by directory, and a batch's rows are clustered by story.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "story string, batch string"
#: Times that a writer tries again after another has taken its number.
TRIES = 20


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, tables: tuple[str, ...] = ("nodes", "edges")):
        """tables: what is published together; each has a column story."""
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self._conf)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in self._names("versions") if n.startswith("v")]

    def version(self) -> int:
        """The latest version; 0 where nothing has been published."""
        return max(self.versions(), default=0)

    def stories(self, version: int | None = None) -> DataFrame:
        """(story, batch) of a version, of the latest by default."""
        version = self.version() if version is None else version
        return self.spark.read.schema(LISTED).parquet(f"{self.root}/versions/v{version:010d}") if version else self.spark.createDataFrame([], LISTED)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """Nodes and edges of one version, without reading rows of batches that it does not name."""
        version = self.version() if version is None else version
        if not version:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        stories = self.stories(version)
        batches = [r[0] for r in stories.select("batch").distinct().collect()]  # no more than publications since the last compaction
        out = {}
        for table in self.tables:
            rows = self.spark.read.option("basePath", f"{self.root}/{table}").option("mergeSchema", True).parquet(*[f"{self.root}/{table}/batch={b}" for b in batches])
            held = stories.select(F.col("story").alias("_story"), F.col("batch").alias("_batch"))
            out[table] = rows.withColumn("batch", F.col("batch").cast("string")).join(held, F.col("story").eqNullSafe(F.col("_story")) & (F.col("batch") == F.col("_batch")), "left_semi").drop("batch")
        return out

    def _dealt(self, rows: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64(*[c for c in ("id", "from_id", "to_id", "from", "type") if c in rows.columns]), F.lit(8))  # a long story fills several tasks
        return rows.repartition("story", salt)

    def _write(self, table: str, rows: DataFrame, batch: str) -> None:
        rows.sortWithinPartitions("story").write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

    def _published(self, batch: str) -> int | None:
        for v in reversed(self.versions()):
            if f"_batch={batch}" in self._names("versions", f"v{v:010d}"):
                return v
        return None

    def _rename(self, made: str, version: int) -> bool:
        """Moves a finished list to its number; False if another has that number."""
        files = self._hadoop.FileContext.getFileContext(self._path().toUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            files.rename(self._path("versions", made), self._path("versions", f"v{version:010d}"), how)
        except Exception as error:
            if "FileAlreadyExists" in str(error) or version in self.versions():
                return False
            raise
        return True

    def publish(self, *rows: DataFrame, stories: DataFrame | None = None, batch: str | None = None, dealt: bool = False) -> int:
        """Replaces the stories of rows, one for each table (or `stories`, so that one may lose all its rows) and returns the version that has them.

        batch: a name for this publication, such as a stream's batch number; the same name is published once.
        dealt: rows come shuffled by story and a part of it, and are written as they lie.
        """
        name = batch or uuid.uuid4().hex
        if batch and (done := self._published(batch)):
            return done
        for table, df in zip(self.tables, rows, strict=True):
            self._write(table, df if dealt else self._dealt(df), name)
        if stories is None:
            written = [self._rows(name, table).select("story") for table in self.tables]
            stories = reduce(DataFrame.unionByName, written)
        return self._list(stories.select("story").distinct().withColumn("batch", F.lit(name)), name)

    def _rows(self, batch: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/batch={batch}")

    def _list(self, changed: DataFrame, batch: str) -> int:
        for _ in range(TRIES):
            version = self.version()
            new = changed.select(F.col("story").alias("_story"))
            old = self.stories(version).join(new, F.col("story").eqNullSafe(F.col("_story")), "left_anti")
            made = f"_{uuid.uuid4().hex}"
            old.unionByName(changed).write.parquet(f"{self.root}/versions/{made}")
            path = self._path("versions", made, f"_batch={batch}")
            path.getFileSystem(self._conf).create(path).close()
            if self._rename(made, version + 1):
                return version + 1
        raise RuntimeError(f"other writers took {TRIES} versions of {self.root} meanwhile")

    def compact(self) -> int:
        """Publishes the latest version again as one batch."""
        rows, batch = self.read(), uuid.uuid4().hex
        for table in self.tables:
            self._write(table, self._dealt(rows[table]), batch)
        return self._list(self.stories().select("story").withColumn("batch", F.lit(batch)), batch)

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the last `keep` versions, and the rows that these don't name. Not while a writer or a reader of an older one is at work."""
        kept = sorted(self.versions())[-keep:]
        live = {r[0] for v in kept for r in self.stories(v).select("batch").distinct().collect()}
        old = [("versions", n) for n in self._names("versions") if n not in {f"v{v:010d}" for v in kept}]
        old += [(t, n) for t in self.tables for n in self._names(t) if n.removeprefix("batch=") not in live]
        for parts in old:
            path = self._path(*parts)
            path.getFileSystem(self._conf).delete(path, True)
