"""X4 and X9 as streams: entities and windows that are right after every batch, in whatever order answers arrive.

The registry is keyed state: for each (story, id) the earliest definition so far. A definition that is earlier than the one known, though it
came later, takes its place, and the changed row is emitted again with a higher revision; `latest` keeps one row for each entity.
The state of an entity is dropped when the watermark has passed its last definition by KEPT; rows that are later than the watermark are
left out by Spark, so this bounds what is kept and says how late an answer may be.

Windows are merged into a published table batch by batch (operators.incremental): a late change splits the window that it lies in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storygraph.operators.incremental import publish_changes
from storygraph.sources.snapshots import GraphStore

DEFINITIONS = "story string, id string, type string, label string, section_idx int, prio int, ord int, seen timestamp"
CHANGES = "story string, section_idx int, ord long, `from` string, to string, type string, caused_by_event string"
REGISTRY = "story string, id string, type string, label string, first_idx int, stub boolean, revision int"
STATE = "section_idx int, prio int, ord int, type string, label string, revision int"


def _first_wins(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, kept_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    known = state.get if state.exists else None
    best, last = known, 0
    for rows in parts:
        last = max(last, int(rows["seen"].max().timestamp() * 1000))
        for r in rows[["section_idx", "prio", "ord", "type", "label"]].itertuples(index=False):
            place = (int(r[0]), int(r[1]), int(r[2]))
            if best is None or place < tuple(best[:3]):
                best = (*place, r[3], r[4], known[5] + 1 if known else 1)
    state.update(best)
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + kept_ms)
    if best is not known:
        yield pd.DataFrame({"story": [key[0]], "id": [key[1]], "type": [best[3]], "label": [best[4]], "first_idx": [best[0]], "stub": [best[1] > 0], "revision": [best[5]]})


def registry(definitions: DataFrame, late: str = "1 hour", kept_ms: int = 3_600_000) -> DataFrame:
    """X4, X5 over a stream of definitions: a row each time that an entity's first definition changes (update mode)."""
    named = definitions.filter("id != ''").withWatermark("seen", late)
    return named.groupBy("story", "id").applyInPandasWithState(lambda key, parts, state: _first_wins(key, parts, state, kept_ms), REGISTRY, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """Of each entity the row of the highest revision."""
    best = rows.groupBy("story", "id").agg(F.max(F.struct("revision", "type", "label", "first_idx", "stub")).alias("m"))
    return best.select("story", "id", "m.type", "m.label", "m.first_idx", "m.stub")


def stream_windows(changes: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """X9 over a stream of changes: each batch is merged into the store's windows, once, however often it is repeated."""

    def batch(df: DataFrame, number: int) -> None:
        publish_changes(store, df, batch=f"changes-{number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
