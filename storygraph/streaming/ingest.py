"""S7 as a stream: answers that arrive as files are parsed and their stories' graphs replaced; finished files aren't read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from storygraph.operators.extraction import parsed

ANSWERS = "story string, section string, section_idx int, raw string"


def answers(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A stream of answers (JSON lines), at most `files` new files in a batch."""
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", files).json(path)


def ingest(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame], None]) -> StreamingQuery:
    """Parses each batch and hands it to write, once for all files there are now. A batch that is repeated after a failure is the same
    batch, so a write that replaces what it wrote (io.write_graph) makes each file count once."""

    def batch(df: DataFrame, number: int) -> None:
        write(parsed(df))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
