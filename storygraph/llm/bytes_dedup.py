"""Dedup of repeated byte strings by the phrases of a prefix-free parse, without its suffix arrays.

A rolling hash of KMER bytes picks the triggers: the place of the least hash among the LENGTH - KMER + 1 places in each string of LENGTH
bytes. They cut every text into phrases, overlapping so far that each string of LENGTH bytes lies in one phrase whole; triggers depend on
the bytes around them alone, so repeated text is parsed alike wherever it stands.

No suffix array is made, of the dictionary, of the parse or of the corpus: equal strings of LENGTH bytes are found by grouping, not by order.
Distinct phrases are grouped by a 128-bit hash of their content; where phrases share a trigger but differ, their strings of LENGTH bytes are
grouped by 128-bit hashes instead. README says why.

Defined cases: a null text is an empty text; texts below LENGTH bytes lose nothing; for null or repeated doc_ids see repeats.keyed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.llm.common import mix
from storygraph.llm.repeats import chunked, covered, repeats, slices, spans

LENGTH, KMER = 100, 32
_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def symbols(text: str) -> np.ndarray:
    return _SYMBOLS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def phrases(row: dict) -> Iterator[tuple]:
    for s in slices(lambda i: symbols(row["texts"][i]), len(row["texts"]), LENGTH):
        yield s.units(KMER)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            doc_ids, texts, later, also = (batch.column(n)[r].as_py() for n in ("doc_ids", "texts", "later", "also"))
            three = spans([later, also])
            cuts = np.searchsorted(three[:, 0], np.arange(len(texts) + 1))
            n_bytes, removed, runs, kept = [], [], [], []
            for i, text in enumerate(texts):
                raw = text.encode("utf-8", "surrogatepass")
                start, end = covered(three[cuts[i] : cuts[i + 1]], len(raw), LENGTH) if cuts[i] < cuts[i + 1] else ((), ())
                at, parts = 0, []
                for a, b in zip(start, end, strict=True):
                    parts.append(raw[at:a])
                    at = b
                n_bytes.append(len(raw))
                runs.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)])
                kept.append(b"".join([*parts, raw[at:]]))
                removed.append(len(raw) - len(kept[-1]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc_ids, n_bytes, removed, runs, kept), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): what is left of each text, as bytes, and the ranges removed."""
    chunks, parts = chunked(docs.select("doc_id", "text"))
    found = repeats(chunks, parts, symbols, LENGTH, phrases)
    return found.mapInArrow(_rows, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB, on whole tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(length(h) // 2)) AS i, h FROM d),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= length(h) THEN hash(substr(h, 2 * i + 1, 200)) END AS gram FROM p),
f AS (SELECT doc_id, i, byte, (gram IS NOT NULL AND row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1)::INT AS again FROM g),
c AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM c),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
