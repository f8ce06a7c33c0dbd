"""What the two substring operators share: finding every run of WIN symbols that also starts earlier in the corpus.

Documents are packed into chunks, the rows of a table that is bucketed by chunk, so that what is found about a chunk is joined with its
texts without moving texts. The runs that start in a chunk are cut into units: neighbouring runs with the same anchor. Equal runs have
equal anchors at equal offsets, so
- a unit whose content was seen before (same anchor, same offsets, same symbols) repeats throughout, and
- only units that share an anchor with other contents are compared run by run.
Each unit is sent once by a task to the bucket of its anchor, which keeps the first of equal contents; a task's own later copies are
settled there. So a passage that a third of all documents hold costs one row for each task, not one for each copy, and no pair of
copies is ever listed.

Contents are compared by 128 bits: two polynomial hashes modulo 2**64 with bases of their own over 64-bit symbols. Anchors only bring
contents together, so 64 bits (32 on the way) are enough for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.llm.common import bucketed, mix, stored

#: Bytes of text in a chunk, and in a bucket of the chunks' table.
CHUNK, BUCKET = 2 << 20, 32 << 20
#: Symbols that are worked on at once; a longer document is taken in slices.
SLICE = 4 << 20
#: Units that a task holds back to settle its own copies.
HELD = 1_000_000
U = np.uint64


def keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """(_id, doc_id, text) with unique _id in the order of documents, and the bytes of all texts.

    _id is doc_id where that is unique. Else rows are numbered in the order of doc_id, nulls last, then text; repeated rows count as
    documents of their own.
    """
    per = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    most, size, nulls = per.agg(F.max("n"), F.sum("b"), F.max(F.col("doc_id").isNull())).first()
    if (most or 0) > 1 or nulls:
        docs = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("_id", F.monotonically_increasing_id())
        docs = stored(docs.select("_id", "doc_id", "text"), "keyed")
    else:
        docs = docs.select(F.col("doc_id").alias("_id"), "doc_id", "text")
    return docs, int(size or 0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    rows, held = [], 0

    def chunk() -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], np.int64)
        name = np.array([xxhash.xxh64_intdigest(ids.tobytes())], U).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(name), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([[r[2] for r in rows]], pa.list_(pa.string()))],
            ["chunk", "ids", "doc_ids", "texts"],
        )

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                rows.append((row[0], row[1], row[2] or ""))
                held += len(rows[-1][2])
                if held >= CHUNK or len(rows) >= 60_000:
                    yield chunk()
                    rows, held = [], 0
    if rows:
        yield chunk()


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """The bucketed table of chunks (chunk, ids, doc_ids, texts), and a number of buckets for what is exchanged about them."""
    spark = docs.sparkSession
    docs, size = keyed(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET + 1)
    rows = docs.mapInArrow(_pack, "chunk long, ids array<long>, doc_ids array<long>, texts array<string>")
    return spark.table(bucketed(rows, "chunks", ("chunk",), parts)), parts


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses."""
    if len(_powers.get(base, ((),))[0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), b, U)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U))
        _powers[base] = tuple(made)
    return _powers[base]


class Hashes:
    """Hashes of any range of an array of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:], dtype=U)

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n]) if n > 0 else np.empty(0, U)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


class Slice:
    """Symbols of whole documents, or of a part of a long one, side by side."""

    def __init__(self, symbols: list[np.ndarray], docs: list[int], bases: list[int], win: int):
        self.sizes = np.array([len(s) for s in symbols], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.docs, self.bases = np.array(docs, np.int64), np.array(bases, np.int64)
        self.symbols = np.concatenate(symbols) if symbols else np.empty(0, U)
        self.hashes, self.win = Hashes(self.symbols), win
        self.second = Hashes(self.symbols, BASES[1])

    def starts_of(self, width: int) -> np.ndarray:
        """Which positions start a run of `width` symbols of one document."""
        ok = np.zeros(max(0, len(self.symbols) - width + 1), bool)
        for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=False):
            ok[a : max(a, a + n - width + 1)] = True
        return ok

    def place(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and position in it."""
        at = np.searchsorted(self.starts, p, "right") - 1
        return self.docs[at], p - self.starts[at] + self.bases[at]

    def units(self, width: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(anchor, content, second content, doc, position, length): an anchor is the least hash of `width` symbols in a run, among the allowed ones."""
        ok = self.starts_of(self.win)
        if not ok.any():
            return tuple(np.empty(0, t) for t in (U, U, U, np.int64, np.int64, np.int64))
        k = self.hashes.every(width)
        v = (k & U(0xFFFFFFFF00000000)) | np.arange(len(k), dtype=U)
        if allowed is not None:
            v[~allowed] = ~U(0)
        least = sliding_min(v, self.win - width + 1)
        ok &= least != ~U(0)
        at = (least & U(0xFFFFFFFF)).astype(np.int64)
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | new[1:]
        p1, p2 = np.flatnonzero(new), np.flatnonzero(last) + 1
        anchor = at[p1]
        at = (anchor - p1).astype(U) * U(0xA24BAED4963EE407)
        content, second = (mix(h.of(p1, p2 - 1 + self.win) + at) for h in (self.hashes, self.second))
        return k[anchor], content, second, *self.place(p1), p2 - p1


def slices(symbols: Callable[[int], np.ndarray], n: int, win: int) -> Iterator[Slice]:
    """The documents of a chunk in slices. symbols(i): those of document i."""
    held, docs, bases, size = [], [], [], 0
    for i in range(n):
        s = symbols(i)
        for a in range(0, max(1, len(s) - win + 1), SLICE):
            part = s[a : a + SLICE + win - 1]
            if held and size + len(part) > SLICE:
                yield Slice(held, docs, bases, win)
                held, docs, bases, size = [], [], [], 0
            held.append(part)
            docs.append(i)
            bases.append(a)
            size += len(part)
    if held:
        yield Slice(held, docs, bases, win)


def _bytes(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _later(whole: np.ndarray, start: np.ndarray, content: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of units by content and place, and which units have the content of one before."""
    order = np.lexsort((start, whole, second, content))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (content[order[1:]] == content[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    return order, later


#: A packed unit's columns: low half of the anchor, both contents, document of the chunk, position, length.
_UNIT = ((0, "<u4"), (1, "<u8"), (2, "<u8"), (3, "<u2"), (4, "<u4"), (5, "<u4"))
_UNIT_BYTES = sum(np.dtype(t).itemsize for _, t in _UNIT)
_FOUND = "chunk long, later binary, rest binary"


def _found(names: np.ndarray, chunk: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, later: np.ndarray, rest: np.ndarray) -> pa.Table:
    """A row for each chunk: its units that are later copies, and the ones to compare run by run, as (doc, start, size) each."""
    three = np.stack([doc, start, size], axis=1).astype("<u4")
    hit = np.flatnonzero(later | rest)
    hit = hit[np.argsort(chunk[hit], kind="stable")]
    cuts = np.flatnonzero(np.diff(chunk[hit], prepend=-1)) if len(hit) else np.empty(0, int)
    rows = [(int(names[chunk[part[0]]]), three[part[later[part]]].tobytes(), three[part[rest[part]]].tobytes()) for part in np.split(hit, cuts[1:]) if len(part)]
    kinds = (pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["chunk", "later", "rest"])


def exchanged(rows: DataFrame, find: Callable[[dict], Iterator[tuple]], buckets: int) -> DataFrame:
    """(chunk, later, rest), several rows for a chunk. find(row of rows) yields the arrays of Slice.units, doc being the document's
    place in the chunk; rows has chunk and ids among its columns."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("units", pa.binary()), ("own", pa.binary())])
        names, ids, held, count = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, content, second, doc, start, size, chunk = (np.concatenate([h[i] for h in held]) for i in range(7))
            base = np.cumsum([0] + [len(x) for x in ids[:-1]])
            whole = np.concatenate(ids)[base[chunk] + doc]
            _, later = _later(whole, start, content, second)
            bucket = ((key >> U(32)) % U(buckets)).astype(np.int64)
            sent = np.flatnonzero(~later)
            sent = sent[np.lexsort((bucket[sent], chunk[sent]))]
            group = chunk[sent] * buckets + bucket[sent]
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            columns = (key, content, second, doc, start, size)
            out = []
            for part in np.split(sent, cuts[1:]) if len(sent) else []:
                c = int(chunk[part[0]])
                used, at = np.unique(doc[part], return_inverse=True)
                body = _bytes(*((at if i == 3 else columns[i][part] & U(0xFFFFFFFF) if i == 0 else columns[i][part]).astype(t) for i, t in _UNIT))
                out.append((int(bucket[part[0]]), names[c], _bytes(ids[c][used], used.astype("<u4")), body, None))
            own = np.flatnonzero(later)
            for c in np.unique(chunk[own]).tolist():
                part = own[chunk[own] == c]
                out.append((c % buckets, names[c], None, None, np.stack([doc[part], start[part], size[part]], axis=1).astype("<u4").tobytes()))
            for at in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out[at : at + 4096], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                names.append(row["chunk"])
                ids.append(np.array(row["ids"], np.int64))
                for units in find(row):
                    held.append((*units, np.full(len(units[0]), len(names) - 1, np.int64)))
                    count += len(units[0])
                if count >= HELD:
                    yield from flush()
                    names, ids, held, count = [], [], [], 0
        if count:
            yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        own = [(c, b) for c, b in zip(table.column("chunk").to_pylist(), table.column("own").to_pylist(), strict=True) if b is not None]
        done = pa.table([pa.array([c for c, _ in own], pa.int64()), pa.array([b for _, b in own], pa.binary()), pa.array([b""] * len(own), pa.binary())], names=["chunk", "later", "rest"])
        names, parts = [], []
        for c, directory, body in zip(*(table.column(n).to_pylist() for n in ("chunk", "ids", "units")), strict=True):
            if body is None:
                continue
            n = len(body) // _UNIT_BYTES
            got, at = [], 0
            for _, t in _UNIT:
                got.append(np.frombuffer(body, t, n, at))
                at += n * np.dtype(t).itemsize
            d = len(directory) // 12
            whole, place = np.frombuffer(directory, "<i8", d), np.frombuffer(directory, "<u4", d, 8 * d)
            parts.append((*got[:3], whole[got[3]], place[got[3]], *got[4:], np.full(n, len(names), np.int64)))
            names.append(c)
        if not parts:
            return done
        key, content, second, whole, doc, start, size, chunk = (np.concatenate([p[i] for p in parts]) for i in range(8))
        order, later = _later(whole, start, content, second)
        first = order[~later[order]]
        first = first[np.argsort(key[first], kind="stable")]
        same = key[first[1:]] == key[first[:-1]]
        rest = np.zeros(len(order), bool)
        rest[first[1:][same]] = True
        rest[first[:-1][same]] = True
        return pa.concat_tables([done, _found(np.array(names, np.int64), chunk, doc, start, size, later, rest)])

    sent = rows.mapInArrow(send, "bucket int, chunk long, ids binary, units binary, own binary")
    return stored(sent.groupBy("bucket").applyInArrow(settle, _FOUND), "repeats", "lz4")


def gathered(found: DataFrame, column: str) -> DataFrame:
    """One row for each chunk, with a list of what was found in it: bounded by the chunk's own length."""
    return found.filter(F.octet_length(column) > 0).groupBy("chunk").agg(F.collect_list(column).alias(column))


def spans(lists: list[list[bytes] | None]) -> np.ndarray:
    """(doc, start, size) rows of what was gathered, in order."""
    raw = b"".join(x for part in lists for x in part or ())
    three = np.frombuffer(raw, "<u4").reshape(-1, 3).astype(np.int64)
    return three[np.lexsort((three[:, 1], three[:, 0]))]


def covered(three: np.ndarray, n: int, win: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges [start, end) of one document of n symbols that runs starting at the given (start, size) cover."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, three[:, 1], 1)
    np.add.at(mark, np.minimum(three[:, 1] + three[:, 2] - 1 + win, n), -1)
    inside = np.cumsum(mark[:n]) > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeats(chunks: DataFrame, parts: int, symbols: Callable[[str], np.ndarray], win: int, units: Callable[[dict], Iterator[tuple]], also: DataFrame | None = None) -> DataFrame:
    """chunks with `later` and `also`, lists of (doc, start, size) of the runs that also start earlier.

    units(row) yields a chunk's units; also: a table (chunk, ...) that units needs, joined to chunks.
    """
    found = exchanged(chunks.join(also, "chunk") if also is not None else chunks, units, parts)

    def runs(row: dict) -> Iterator[tuple]:
        three = spans([row["rest"]])
        wanted = {int(d): three[three[:, 0] == d] for d in np.unique(three[:, 0])}
        for d, own in wanted.items():
            h = symbols(row["texts"][d])
            start = np.concatenate([np.arange(a, a + n) for _, a, n in own])
            base, size = int(start.min()), int(start.max()) + win
            value, second = (Hashes(h[base:size], b).of(start - base, start - base + win) for b in BASES)
            yield value, value, second, np.full(len(start), d, np.int64), start, np.ones(len(start), np.int64)

    again = exchanged(chunks.join(gathered(found, "rest"), "chunk"), runs, parts)
    return chunks.join(gathered(found, "later"), "chunk", "left").join(gathered(again, "later").withColumnRenamed("later", "also"), "chunk", "left")
