"""Substring dedup of words by fixed-block anchors.

Every document is cut into blocks of BLOCK words, one after the other: the reference blocks. A window of WIN = 2 * BLOCK words holds one
of its document's blocks whole. All blocks are indexed by hash, and every rolling window of BLOCK words of every document probes the
index; a block that some other place holds too is an anchor, at all its places. A repeated window has an anchor at the same offset in
each of its copies, so hits are extended around their anchors: windows with the same anchor make a unit, units are compared as wholes
and, where they differ, window by window, and what repeats is joined to maximal repeats (repeats.py).

Probes travel as 32 bits of hash and a byte for the distance from the last probe of the same bucket; a false hit by these bits only costs
a comparison. A chunk sends each hash once, however often it holds it.

Defined cases: a null text has no words; documents of fewer than WIN words lose nothing; for null or repeated doc_ids see repeats.keyed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.llm.common import WordHashes, stored
from storygraph.llm.repeats import Slice, chunked, covered, repeats, slices, spans

WIN, BLOCK = 20, 10
U = np.uint64
_own: dict = {}


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space alone


def symbols(text: str) -> np.ndarray:
    return _own.setdefault("words", WordHashes()).of(words(text))


def _slices(row: dict) -> Iterator[Slice]:
    return slices(lambda i: symbols(row["texts"][i]), len(row["texts"]), WIN)


def _gaps(g: np.ndarray) -> bytes:
    """Increasing places as bytes: the count of wide gaps, their places and values, then a byte for each gap."""
    gap = np.diff(g, prepend=0)
    wide = np.flatnonzero(gap > 255)
    return np.array([len(wide)], "<u4").tobytes() + wide.astype("<u4").tobytes() + gap[wide].astype("<u4").tobytes() + np.where(gap > 255, 0, gap).astype(np.uint8).tobytes()


def _places(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    gap = np.frombuffer(raw, np.uint8, offset=4 + 8 * n).astype(np.int64)
    gap[np.frombuffer(raw, "<u4", n, 4)] = np.frombuffer(raw, "<u4", n, 4 + 4 * n)
    return np.cumsum(gap)


def anchors(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, marks): places, by slice, of rolling blocks that are anchors; only the first place of each hash in a slice."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("slice", pa.int32()), ("hashes", pa.binary()), ("gaps", pa.binary()), ("flags", pa.binary())])
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in ("chunk", "texts")}
                for number, s in enumerate(_slices(row)):
                    h = s.hashes.every(BLOCK)
                    at = np.flatnonzero(s.starts_of(BLOCK))
                    if not len(at):
                        continue
                    value, first, back, count = np.unique(h[at], return_index=True, return_inverse=True, return_counts=True)
                    block = s.place(at)[1] % BLOCK == 0
                    indexed = np.zeros(len(value), bool)
                    indexed[back[block]] = True
                    bucket = ((value >> U(32)) % U(buckets)).astype(np.int64)
                    order = np.lexsort((first, bucket))
                    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                    rows = [
                        (int(bucket[p[0]]), row["chunk"], number, (value[p] & U(0xFFFFFFFF)).astype("<u4").tobytes(), _gaps(at[first[p]]), np.packbits(np.concatenate([indexed[p], count[p] > 1])).tobytes())
                        for p in np.split(order, cuts[1:])
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def match(table: pa.Table) -> pa.Table:
        chunk, number, hashes, gaps, flags = (table.column(n).to_pylist() for n in ("chunk", "slice", "hashes", "gaps", "flags"))
        sizes = [len(x) // 4 for x in hashes]
        h = np.frombuffer(b"".join(hashes), "<u4")
        bits = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * n).reshape(2, n) for f, n in zip(flags, sizes, strict=True)]
        indexed, twice = np.concatenate(bits, axis=1)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.diff(h[order].astype(np.int64), prepend=-1))
        length = np.diff(np.append(starts, len(h)))
        many = (length > 1) | np.logical_or.reduceat(twice[order] > 0, starts)
        hit = np.zeros(len(h), bool)
        hit[order] = np.repeat(many & np.logical_or.reduceat(indexed[order] > 0, starts), length)
        rows, at = [], 0
        for i, n in enumerate(sizes):
            own = hit[at : at + n]
            at += n
            if own.any():
                rows.append((chunk[i], number[i], _gaps(_places(gaps[i])[own])))
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "slice", "places"])

    sent = chunks.mapInArrow(probe, "bucket int, chunk long, slice int, hashes binary, gaps binary, flags binary")
    found = stored(sent.groupBy("bucket").applyInArrow(match, "chunk long, slice int, places binary"), "anchors", "lz4")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("slice", "places")).alias("marks"))


def _units(row: dict) -> Iterator[tuple]:
    marks: dict[int, list[np.ndarray]] = {}
    for m in row["marks"]:
        marks.setdefault(m["slice"], []).append(_places(m["places"]))
    for number, s in enumerate(_slices(row)):
        if number not in marks:
            continue
        h = s.hashes.every(BLOCK)
        allowed = np.isin(h, h[np.concatenate(marks[number])]) & s.starts_of(BLOCK)
        yield s.units(BLOCK, allowed)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            doc_ids, texts, later, also = (batch.column(n)[r].as_py() for n in ("doc_ids", "texts", "later", "also"))
            three = spans([later, also])
            cuts = np.searchsorted(three[:, 0], np.arange(len(texts) + 1))
            n_words, removed, kept = [], [], []
            for i, text in enumerate(texts):
                ws = words(text)
                n_words.append(len(ws))
                if cuts[i] < cuts[i + 1]:
                    at, left = 0, []
                    for a, b in zip(*(x.tolist() for x in covered(three[cuts[i] : cuts[i + 1]], len(ws), WIN)), strict=True):
                        left += ws[at:a]
                        at = b
                    ws = left + ws[at:]
                removed.append(n_words[-1] - len(ws))
                kept.append(b" ".join(ws).decode("utf-8", "replace"))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc_ids, n_words, removed, kept), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left of each text, joined by spaces."""
    chunks, parts = chunked(docs.select("doc_id", "text"))
    found = repeats(chunks, parts, symbols, WIN, _units, anchors(chunks, parts))
    return found.mapInArrow(_rows, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB, on whole tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT *, string_agg(word, ' ') OVER r AS gram, count(*) OVER r AS n FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, word, i, (n = 20 AND row_number() OVER (PARTITION BY n, gram ORDER BY doc_id, i) > 1)::INT AS again FROM g),
c AS (SELECT doc_id, word, i, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
