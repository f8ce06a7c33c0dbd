"""Phrase collocations by dynamic itemset counting: lengths are counted together, in cyclic scans of shards.

Documents are dealt into SHARDS shards, which are scanned one after the other, again and again. Words are counted from the first scan on.
A longer phrase is activated once both of its subphrases (without its last and without its first word) have reached `least` in the counts
so far; it is counted in the next SHARDS scans, one full cycle, and then complete. Scans end when no phrase is active any more.

What phrases have reached `least` is told to the tasks by a filter, each byte holding the scan after which the first phrase of that place
did. A place shared with another phrase only activates a phrase early, and for a full cycle as well. Phrases are 64-bit hashes while they
are counted. With each count goes the smallest id of a document that the phrase is in, its witness, and the sum of a second hash over its
occurrences. The words of a frequent phrase are read from its witness alone, so that each phrase makes one row, however many tasks it
occurs in; all that follows joins words, not hashes. Where phrases shared a hash, their count is no multiple of one second hash: then
(with one sum wrong in 2^CHECK such cases) one more scan reads the words and exact counts of all phrases found, a superset of what is wanted.

The filter grows when less than ROOM bytes are left for each phrase in it, and that scan's has BITS for each phrase, so
that the share of other phrases they let through does not grow with the data. A grown filter repeats the old one, so that what it says of
a phrase stays: the scan in which a phrase's counts begin must not change under it. Above MOST bytes (4 and 32 million phrases) they grow
no more: then more phrases are counted that are dropped later, which costs rows and no results.

Defined cases: a null or empty text has no words; a null lang counts as `und`; rows that repeat count as documents of their own, null ids
and all other columns are ignored; an empty table gives an empty result. Of equal scores and counts the phrase that sorts first in UTF-8
bytes goes first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storygraph.llm.common import mix, rolling, scratch_path, stored

LONGEST = 4
LEAST = 30
TOP = 2000
#: A phrase goes if a longer candidate that holds it has this percentage of its occurrences.
INSIDE = 80
SHARDS = 3
#: Bytes of the filters at first and at most (powers of 2).
FILTER, MOST = 1 << 16, 1 << 26
#: Bytes for each phrase, and for each word of the first scan (longer phrases follow); bits for each phrase, and its places, in the last filter.
ROOM, ROOM_FIRST, BITS, PLACES = 16, 64, 16, 4
NEVER = 255
#: Occurrences that a task counts before it hands them on.
FLUSH = 2_000_000
#: Phrases that a task counts by their words before it hands them on.
KNOWN = 500_000
#: Bits of the second hash of a phrase, and of a language: sums over all their occurrences stay below 2^63.
CHECK, CHECK_LANG = 30, 16

#: Ends of pieces become \n, tabs spaces.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_own: dict = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse, modulo 2^64."""
    if len(_own.get(base, ((),))[0]) < n:
        power = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))])
        _own[base] = power(base), power(pow(base, -1, 1 << 64))
    return _own[base]


class _Slice:
    """The words of some texts: places, hashes, the hash of the language, the text's id, and the piece that each lies in."""

    def __init__(self, langs: list[bytes], texts: list[bytes], ids: list[int]):
        self.text = b"\n".join([*texts, b""]).lower().translate(_ENDS)
        self.chars = np.frombuffer(self.text, np.uint8)
        inside = np.concatenate([[False], (self.chars != 32) & (self.chars != 10)])  # the last one is an end
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.h = self._words(_BASES[0])
        self.piece = np.cumsum(self.chars == 10)[self.starts]
        self.langs, self.each = langs, np.diff(np.searchsorted(self.starts, np.cumsum([0] + [len(t) + 1 for t in texts])))
        self.lang = self._langs(5)
        self.id = np.repeat(np.array(ids, np.int64), self.each)
        self._second = None

    def _words(self, base: int) -> np.ndarray:
        power, inverse = _powers(base, len(self.chars) + 1)
        sums = np.cumsum((self.chars.astype(np.uint64) + np.uint64(1)) * power[: len(self.chars)])
        before = np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0))
        return mix((sums[self.ends - 1] - before) * inverse[self.starts])

    def _langs(self, seed: int) -> np.ndarray:
        import xxhash

        return np.repeat(np.array([xxhash.xxh64_intdigest(x, seed) for x in self.langs], np.uint64), self.each)

    def keys(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word the key of the phrase of that length that it begins, and whether it is one."""
        key = rolling(self.h, length, seed=length)
        return mix(key ^ self.lang[: len(key)]), self.piece[: len(key)] == self.piece[length - 1 :]

    def checks(self, length: int) -> np.ndarray:
        """For each word the second hash of the phrase of that length that it begins; length 0: of its language."""
        if self._second is None:
            self._second = self._words(_BASES[1]), self._langs(6)
        h, lang = self._second
        if not length:
            return (lang >> np.uint64(64 - CHECK_LANG)).astype(np.int64)
        key = rolling(h, length, seed=LONGEST + length)
        return (mix(key ^ lang[: len(key)]) >> np.uint64(64 - CHECK)).astype(np.int64)

    def phrase(self, i: int, length: int) -> bytes:
        return b" ".join(self.text[self.starts[i] : self.ends[i + length - 1]].split())


def _places(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(size - 1)
    return key & m, (key >> np.uint64(32)) & m


def _phrases(s: _Slice, scan: int, reached: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, key, begin, since): begin is the scan from which on a place's phrase is counted, since the one after which it is in the filter."""
    since = None
    for length in range(1, LONGEST + 1):
        key, valid = s.keys(length)
        if not len(key):
            return
        begin = np.zeros(len(key), np.int16) if since is None else np.maximum(since[:-1], since[1:]) + np.int16(1)
        begin[~valid] = NEVER + 1
        now = np.flatnonzero(begin <= scan)
        a, b = _places(key[now], len(reached))
        since = np.full(len(key), NEVER, np.int16)
        since[now] = np.maximum(np.maximum(reached[a], reached[b]).astype(np.int16), begin[now])
        yield length, key, begin, since


def _sliced(batches: Iterator[pa.RecordBatch], bytes_each: int = 1 << 20) -> Iterator[_Slice]:
    """Texts of (lang, text, id), in parts of a bounded number of bytes (or one text)."""
    for batch in batches:
        rows, size = [], 0
        for row in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rows.append(row)
            size += len(row[1])
            if size > bytes_each:
                yield _Slice(*map(list, zip(*rows, strict=True)))
                rows, size = [], 0
        if rows:
            yield _Slice(*map(list, zip(*rows, strict=True)))


def _counter(scan: int, reached) -> Callable:
    """(length, begin, key, n, check, at) of the phrases active in a scan, added up in parts; length 0: the words of each language."""

    def made(length: int, begin: int, key, *rest) -> pa.RecordBatch:
        same = [pa.array(np.full(len(key), x, np.int16)) for x in (length, begin)]
        return pa.RecordBatch.from_arrays([*same, pa.array(key.view(np.int64)), *map(pa.array, rest)], ["length", "begin", "key", "n", "check", "at"])

    def counted(held: dict[tuple[int, int], list[tuple]]) -> Iterator[pa.RecordBatch]:
        for which, parts in held.items():
            key, check, at = map(np.concatenate, zip(*parts, strict=True))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key))).astype(np.int64)
            yield made(*which, key[first], n, np.add.reduceat(check[order], first), np.minimum.reduceat(at[order], first))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, langs = {}, 0, {}
        for s in _sliced(batches):
            if scan < SHARDS and len(s.h):
                key, first, n = np.unique(s.lang, return_index=True, return_counts=True)
                of = s.checks(0)
                for k, i, m in zip(key.tolist(), first.tolist(), n.tolist(), strict=True):
                    have = langs.get(k, (0, 0, s.id[i]))
                    # Sums over words of one language, as if word by word.
                    langs[k] = have[0] + m, have[1] + int(of[s.lang == np.uint64(k)].sum()), min(have[2], s.id[i])
            for length, key, begin, _ in _phrases(s, scan, reached.value):
                of = None
                for since in range(max(0, scan - SHARDS + 1), scan + 1):
                    active = np.flatnonzero(begin == since)
                    if len(active):
                        of = s.checks(length) if of is None else of
                        held.setdefault((length, since), []).append((key[active], of[active], s.id[active]))
                        size += len(active)
            if size > FLUSH:
                yield from counted(held)
                held, size = {}, 0
        yield from counted(held)
        if langs:
            yield made(0, 0, np.array(list(langs), np.uint64), *np.array(list(langs.values()), np.int64).T.copy())

    return count


def _held(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether all places of a key are set; bits: 64 places each, a power of 2 of them."""
    a, b = _places(key, len(bits) * 64)
    out = np.ones(len(key), bool)
    for i in range(PLACES):
        at = np.flatnonzero(out)
        p = (a[at] + np.uint64(i) * b[at]) & np.uint64(len(bits) * 64 - 1)
        out[at] = (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0
    return out


def _found(s: _Slice, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, key, at): where phrases of the filter begin whose subphrases are in it too."""
    inside = None
    for length in range(1, LONGEST + 1):
        key, valid = s.keys(length)
        if not len(key):
            return
        at = np.flatnonzero(valid if inside is None else valid & inside[:-1] & inside[1:])
        at = at[_held(key[at], bits)]
        inside = np.zeros(len(key), bool)
        inside[at] = True
        yield length, key, at


def _reader() -> Callable:
    """(lang, length, phrase, key, of) of the keys that each text of (lang, text, id, keys) is to be read for; of: the second hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = dict(zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True))
            lists = dict(zip(batch.column(2).to_pylist(), batch.column(3), strict=True))
            for s in _sliced([batch]):
                keys = [(i, lists[i].values.to_numpy()) for i in np.unique(s.id).tolist()]
                wanted = {(i, k) for i, each in keys for k in each.tolist()}
                both = np.concatenate([mix(np.full(len(each), i, np.int64).view(np.uint64)) ^ each.view(np.uint64) for i, each in keys] or [np.empty(0, np.uint64)])
                for length in range(LONGEST + 1):
                    key, valid = s.keys(length) if length else (s.lang, np.ones(len(s.lang), bool))
                    if not len(key):
                        break
                    at = np.flatnonzero(valid)
                    at = at[np.isin(mix(s.id[at].view(np.uint64)) ^ key[at], both)]
                    _, first = np.unique(mix(s.id[at].view(np.uint64)) ^ key[at], return_index=True)
                    at = at[first]
                    at = at[np.fromiter(((i, k) in wanted for i, k in zip(s.id[at].tolist(), key[at].view(np.int64).tolist(), strict=True)), bool, len(at))]
                    made = [pa.array([langs[i] for i in s.id[at].tolist()], pa.string()), pa.array(np.full(len(at), length, np.int16)), pa.array([s.phrase(i, length) if length else None for i in at.tolist()], pa.binary()).cast(pa.string()), pa.array(key[at].view(np.int64)), pa.array(s.checks(length)[at])]
                    yield pa.RecordBatch.from_arrays(made, ["lang", "length", "phrase", "key", "of"])

    return read


def _counting_reader(bits) -> Callable:
    """(lang, length, phrase, n) of the phrases in the filter, told apart by their words, and for each language, with a null phrase, the number of words."""

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        langs, lengths, phrases = zip(*counts, strict=True)
        made = [pa.array(langs, pa.binary()).cast(pa.string()), pa.array(lengths, pa.int16()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())]
        yield from pa.Table.from_arrays(made, ["lang", "length", "phrase", "n"]).to_batches(1 << 15)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for s in _sliced(batches):
            counts.update({(lang, 0, None): n for lang, n in _by_lang(s).items()})
            text = np.repeat(np.arange(len(s.langs)), s.each)
            for length, _, at in _found(s, bits.value):
                counts.update((s.langs[j], length, s.phrase(i, length)) for i, j in zip(at.tolist(), text[at].tolist(), strict=True))
            if len(counts) > KNOWN:
                yield from rows(counts)
                counts = Counter()
        if counts:
            yield from rows(counts)

    return read


def _by_lang(s: _Slice) -> Counter:
    """Words of each language that has any."""
    out = Counter()
    for lang, n in zip(s.langs, s.each.tolist(), strict=True):
        if n:
            out[lang] += n
    return out


def _size(n: int, each: int, least: int) -> int:
    """A power of 2, `each` for each of n phrases."""
    return max(least, 1 << max(0, n * each - 1).bit_length())


def _learned(reached: np.ndarray, keys: DataFrame, scan: int) -> None:
    """Puts keys into the filter. The driver sees places of the filter, MOST at most."""
    place = lambda key: key.bitwiseAND(F.lit(len(reached) - 1)).cast("int")
    places = keys.select(F.explode(F.array(place(F.col("key")), place(F.shiftrightunsigned("key", 32)))).alias("p")).distinct().toArrow()
    at = places.column("p").to_numpy()
    at = at[reached[at] == NEVER]
    reached[at] = scan


def _bits(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of n keys for the last scan, 64 places in each number. The driver sees these numbers, MOST bytes of them at most."""
    size = min(_size(n, BITS, 1 << 16), MOST * 8)
    half = lambda key: key.bitwiseAND(F.lit(size - 1))
    a, b = half(F.col("key")), half(F.shiftrightunsigned("key", 32))
    places = keys.select(F.explode(F.array(*[half(a + i * b) for i in range(PLACES)])).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    made = places.groupBy(F.shiftright("p", 6).cast("int").alias("at")).agg(F.bit_or(one).alias("set")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[made.column("at").to_numpy()] = made.column("set").to_numpy().view(np.uint64)
    return bits


def sharded(docs: DataFrame) -> DataFrame:
    """(lang, text, id, shard), stored by shard; ids are given as the rows are stored."""
    path = scratch_path(docs.sparkSession, "phrase-shards")
    shard = F.pmod(F.xxhash64("text", "lang"), F.lit(SHARDS)).cast("int")
    rows = docs.filter("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.monotonically_increasing_id().alias("id"), shard.alias("shard"))
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("lang string, text string, id long, shard int").parquet(path)


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, length, phrase, n): the phrases of up to LONGEST words that occur `least` times in their language; length 0: all words."""
    spark = docs.sparkSession
    shards, reached = sharded(docs), np.full(FILTER, NEVER, np.uint8)
    active, ready, n, scan, last = None, [], 0, 0, -1
    while scan < SHARDS or scan <= last + SHARDS:  # a phrase activated after scan `last` is counted up to scan last + SHARDS
        if scan >= NEVER - 1:
            raise RuntimeError("phrases of LONGEST words are complete after LONGEST cycles")
        shared = spark.sparkContext.broadcast(reached)
        part = shards.filter(F.col("shard") == scan % SHARDS).select("lang", "text", "id")
        part = part.mapInArrow(_counter(scan, shared), "length short, begin short, key long, n long, check long, at long").withColumn("since", F.lit(None).cast("int"))
        counts = part if active is None else active.unionByName(part)
        counts = counts.groupBy("length", "begin", "key").agg(*[F.sum(c).alias(c) for c in ("n", "check")], *[F.min(c).alias(c) for c in ("at", "since")])
        counts = stored(counts.withColumn("since", F.coalesce("since", F.when(F.col("n") >= least, scan))), "phrase-counts", "snappy")
        shared.destroy()
        new = counts.filter((F.col("since") == scan) & F.col("length").between(1, LONGEST - 1)).select("key")
        if more := new.count():
            wanted = min(_size(n + more, ROOM_FIRST if last < 0 else ROOM, len(reached)), max(MOST, len(reached)))
            n, last = n + more, scan
            reached = np.tile(reached, wanted // len(reached))
            _learned(reached, new, scan)
        complete = F.col("begin") + (SHARDS - 1) == scan
        ready.append(counts.filter(complete & ((F.col("n") >= least) | (F.col("length") == 0))).select("length", "key", "n", "check", "at"))
        active = counts.filter(~complete)
        scan += 1
    found = reduce(DataFrame.unionByName, ready)
    witnesses = found.groupBy(F.col("at").alias("id")).agg(F.collect_list("key").alias("keys"))
    read = shards.select("lang", "text", "id").join(witnesses, "id").select("lang", "text", "id", "keys")
    read = read.mapInArrow(_reader(), "lang string, length short, phrase string, key long, of long")
    sure = F.coalesce(F.col("n") * F.col("of") == F.col("check"), F.lit(False))
    phrases = stored(found.join(read, ["length", "key"], "left").select("lang", "length", "phrase", "n", sure.alias("_sure")), "phrases")
    if phrases.filter("NOT _sure").isEmpty():
        return phrases.drop("_sure")
    return _counted_by_words(shards, found.filter("length > 0").select("key"), least)


def _counted_by_words(shards: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """What frequent() returns, where different phrases among these keys share one: every task counts all of them by their words."""
    shared = shards.sparkSession.sparkContext.broadcast(_bits(keys, keys.count()))
    read = shards.select("lang", "text", "id").mapInArrow(_counting_reader(shared), "lang string, length short, phrase string, n long")
    phrases = stored(read.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("length") == 0)), "phrases")
    shared.destroy()
    return phrases


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one stands for. phrases: frequent()."""
    ws = F.split("phrase", " ")
    part = lambda i, n: F.array_join(F.slice(ws, i, n), " ")
    found = phrases.filter("length > 1").select("lang", "phrase", "length", F.col("n").alias("a"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_first"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("_rest"))
    known = phrases.filter("length > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l")), ["lang", "_first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r")), ["lang", "_rest"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + r) AS BIGINT)")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # Each phrase that lies in a longer candidate, with the most occurrences of one.
    inner = found.filter("length > 2").withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    inner = inner.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("_n") + 1)))
    inner = inner.select("lang", part(F.col("_i"), F.col("_n")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = least.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a")))
    return kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of docs (lang, text)."""
    phrases = frequent(docs.select("lang", "text"), least)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(phrases).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    words = phrases.filter("length = 0").select("lang", F.col("n").alias("_n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("_n").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB, on whole tables.
ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, length, unnest(list_transform(range(1, len(ws) - length + 2), lambda i: array_to_string(ws[i : i + length - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS length)),
f AS (SELECT lang, length, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE length > 1),
k AS (SELECT *, array_to_string(ws[:k], ' ') AS first_part, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, length)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, (2000000::HUGEINT * k.a // (x.a::HUGEINT + y.a))::BIGINT AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = first_part JOIN f y ON y.lang = k.lang AND y.phrase = rest),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, size, ws, unnest(range(1, length - size + 2)) AS j FROM (SELECT *, unnest(range(2, length)) AS size FROM c WHERE length > 2)),
b AS (SELECT lang, array_to_string(ws[j : j + size - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN b USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
