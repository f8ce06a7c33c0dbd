"""X9, X10 without recomputing: late state changes are put into windows that stand, next to their neighbours.

windows: (story, from, type, to, valid_from, at, until, valid_until); at is a change's place, a struct (section_idx, ord), valid_from the
event that made it, until and valid_until those of the next change of the same (story, from, type), null where there is none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.operators.intervals import interval_join
from storygraph.sources.snapshots import GraphStore

KEY = ["story", "from", "type"]
COLUMNS = [*KEY, "to", "valid_from", "at", "until", "valid_until"]


#: Parts that a story's keys are dealt to.
SALTS = 8


def windows(changes: DataFrame) -> DataFrame:
    """The windows of changes (story, section_idx, ord, from, to, type, caused_by_event), all at once."""
    return _linked(_dealt(_placed(changes)))


def _placed(changes: DataFrame) -> DataFrame:
    return changes.select(*KEY, "to", F.col("caused_by_event").alias("valid_from"), F.struct("section_idx", "ord").alias("at"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows by story and a part of its keys: the one shuffle that merging, linking and writing them need."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64("from", "type"), F.lit(SALTS))).repartition("story", "_salt")


def _linked(rows: DataFrame) -> DataFrame:
    """Dealt rows as windows, each up to the next one of its key."""
    by = Window.partitionBy(*KEY, "_salt").orderBy("at")
    return rows.withColumns({"until": F.lead("at").over(by), "valid_until": F.lead("valid_from").over(by)}).select(*COLUMNS)


def merged(old: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, gone): the windows that changes add or shorten, and the keys (story, from, type, at) of those in old that they stand for.

    A change lies in one gap: in a window of its key, or before the first one. The changes of a gap are linked with one another and with
    its two ends; no other window is looked at but the ones of the same sections. Changes that are there already are left out.
    """
    same = [*KEY, "at"]
    late = _placed(changes).dropDuplicates(same).join(old.select(*same), same, "left_anti").withColumn("_section", F.col("at.section_idx"))
    spans = old.select(*KEY, F.col("at").alias("_at"), F.col("until").alias("_until"), F.col("valid_until").alias("_valid_until"), F.col("at.section_idx").alias("_begin"), (F.col("until.section_idx") + 1).alias("_end"))
    held = interval_join(late, spans, KEY, "_section", "_begin", "_end").filter((F.col("_at") < F.col("at")) & (F.col("_until").isNull() | (F.col("at") < F.col("_until"))))
    first = old.groupBy(*KEY).agg(F.min(F.struct("at", "valid_from")).alias("_next"))
    ahead = late.join(held.select(*same), same, "left_anti").join(first, KEY, "left")
    ahead = ahead.select(*KEY, "to", "valid_from", "at", F.lit(None).cast(old.schema["at"].dataType).alias("_at"), F.col("_next.at").alias("_until"), F.col("_next.valid_from").alias("_valid_until"))
    gaps = held.select(*ahead.columns).unionByName(ahead)
    by = Window.partitionBy(*KEY, "_at").orderBy("at")
    added = gaps.withColumns({"until": F.coalesce(F.lead("at").over(by), "_until"), "valid_until": F.coalesce(F.lead("valid_from").over(by), "_valid_until")})
    cut = gaps.filter("_at IS NOT NULL").groupBy(*KEY, F.col("_at").alias("at")).agg(F.min(F.struct("at", "valid_from")).alias("_next"))
    shorter = old.drop("until", "valid_until").join(cut, same).withColumns({"until": F.col("_next.at"), "valid_until": F.col("_next.valid_from")})
    return added.select(*COLUMNS).unionByName(shorter.select(*COLUMNS)), cut.select(*same)


def applied(old: DataFrame, changes: DataFrame) -> DataFrame:
    """old with changes merged in. Who writes the result reads all of old, so both are sorted together, which costs less than to look for
    the neighbours alone as `merged` does; what is there already stays."""
    both = old.select(*KEY, "to", "valid_from", "at", F.lit(0).alias("_late")).unionByName(_placed(changes).withColumn("_late", F.lit(1)))
    first = _dealt(both).groupBy(*KEY, "_salt", "at").agg(F.min(F.struct("_late", "to", "valid_from")).alias("_r"))
    return _linked(first.select(*KEY, "_salt", "at", "_r.to", "_r.valid_from"))


def publish_changes(store: GraphStore, changes: DataFrame, batch: str | None = None) -> int:
    """Merges changes into the windows that a store with the one table `windows` holds. Stories without a change keep their files."""
    path = f"{store.root}/touched/{uuid.uuid4().hex}"
    changes.select("story").distinct().write.parquet(path)  # stored, so that Spark knows how few they are and no window is shuffled to meet them
    touched = store.spark.read.schema("story string").parquet(path)
    if not store.version():
        return store.publish(windows(changes), stories=touched, batch=batch, dealt=True)
    old = store.read()["windows"].join(touched, "story", "left_semi")
    return store.publish(applied(old, changes), stories=touched, batch=batch, dealt=True)


def state_edges(df: DataFrame) -> DataFrame:
    """Windows as state edges, numbered as operators.objective.state_windows does."""
    first = F.min("at").over(Window.partitionBy(*KEY))
    n = F.row_number().over(Window.partitionBy("story").orderBy("_first", "at"))
    return df.withColumn("_first", first).select(
        "story", F.concat(F.lit("state_"), n.cast("string")).alias("id"), "from", "to", "type", "valid_from", "valid_until", F.array("valid_from").alias("caused_by")
    )
