"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's symbols stand in a row; leaf i of a binary tree holds the rank of the merge of symbol i with its right neighbour, and each
inner node the least of its two children. So the root is the leftmost merge of lowest rank; carrying it out changes three leaves,
each updated along one path, until the root says that no pair can be merged. A word of n symbols takes O(n log n), however long.

Texts are cut at the tokenizer's special tokens, normalised and split into words as the tokenizer's file says. Each task keeps the ids
of the last words it met, up to a bound, since most words of a text are common ones.

Defined cases: a null text is an empty text; texts without tokens have no ids and decode to an empty text; ids that the vocabulary
lacks are skipped in decoding.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space by Unicode, spelt out because libraries differ on the control characters 1C to 1F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed by the tokenizer's file: what a word is.
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+"
#: Words that a task remembers, twice over (lately met, and before).
REMEMBERED = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str) -> dict:
    """What tasks need of a tokenizer's file, read once by the driver: tokens by id, merges in order, special tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab = file["model"]["vocab"]
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    tokens: list[str | None] = [None] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in [*vocab.items(), *special.items()]:
        tokens[i] = token
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
    return {"tokens": tokens, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], "special": special, "end": file["model"]["end_of_word_suffix"]}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def merge(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Carries out the merges on one word's symbols. pairs: rank and merged symbol by (left << 20 | right)."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    none = 1 << 60
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if found := pairs.get(ids[i] << 20 | ids[i + 1]):
            tree[size + i] = found[0] * size + i  # of equal ranks the leftmost is least
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        at = size + leaf
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if tree[at] == value:
                return
            tree[at] = value

    while tree[1] != none:
        i = tree[1] % size
        j = after[i]
        ids[i] = new = pairs[ids[i] << 20 | ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, none)
        value = none
        if k < n:
            before[k] = i
            if found := pairs.get(new << 20 | ids[k]):
                value = found[0] * size + i
        put(i, value)
        if (h := before[i]) >= 0:
            found = pairs.get(ids[h] << 20 | new)
            put(h, found[0] * size + h if found else none)
    return [x for x in ids if x >= 0]


class Encoder(dict):
    """Ids of words, as little-endian unsigned 32-bit integers, by word."""

    def __init__(self, model: dict):
        import regex

        self.older: dict = {}
        self.find = regex.compile(_WORD).findall
        self.special = {t: struct.pack("<I", i) for t, i in model["special"].items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        ids = {t: i for i, t in enumerate(model["tokens"]) if t is not None}
        letters = byte_letters()
        self.inner, self.last = [ids[x] for x in letters], [ids[x + model["end"]] for x in letters]
        self.pairs = {a << 20 | b: (rank, c) for rank, (a, b, c) in enumerate(model["merges"])}

    def __missing__(self, word: str) -> bytes:
        out = self.older.pop(word, None)
        if out is None:
            raw = word.encode("utf-8", "surrogatepass")
            ids = merge([*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]], self.pairs)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:  # words met lately stay, those that did not come up again since go
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def plain(self, text: str) -> bytes:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # Letter by letter where a letter's lower case would depend on its neighbours.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not any(t in text for t in self.special):
            return self.plain(text)
        return b"".join(self.special[x] if x in self.special else self.plain(x) for x in self.cut.split(text) if x)


_made: dict = {}


def _own(kind: str, key: str, model, make):
    """One object for each worker process and model."""
    if (kind, key) not in _made:
        _made[kind, key] = make(model.value)
    return _made[kind, key]


class Bpe:
    """encode() and decode() as columns, or both at once over a table; ids are packed: 4 bytes each, little-endian."""

    #: Rows that a task turns into Python objects at once.
    ROWS = 128

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.model = spark.sparkContext.broadcast(load(path or default_path()))  # a vocabulary of fixed size
        self.key = uuid.uuid4().hex

    def encode(self, text: Column) -> Column:
        model, key = self.model, self.key

        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = _own("encoder", key, model, Encoder)
            for texts in batches:
                yield pd.Series([own.encode(x) for x in texts], dtype=object)

        return F.pandas_udf(encode, "binary")(text)

    def decode(self, ids: Column) -> Column:
        model, key = self.model, self.key

        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokens = _own("tokens", key, model, lambda m: m["tokens"])
            for packed in batches:
                yield pd.Series([decoded(x, tokens) for x in packed], dtype=object)

        return F.pandas_udf(decode, "string")(ids)

    def both(self, docs: DataFrame) -> DataFrame:
        """docs with ids, n_tokens and decoded, in one pass of one worker."""
        model, key, rows = self.model, self.key, self.ROWS
        at = docs.columns.index("text")
        schema = T.StructType([f for f in docs.schema if f.name not in ("ids", "n_tokens", "decoded")])
        keep = [i for i, f in enumerate(docs.schema) if f.name not in ("ids", "n_tokens", "decoded")]
        schema = schema.add("ids", "binary").add("n_tokens", "long").add("decoded", "string")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, tokens = _own("encoder", key, model, Encoder), _own("tokens", key, model, lambda m: m["tokens"])
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    ids = [own.encode(x) for x in part.column(at).to_pylist()]
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    made = [pa.array(ids, pa.binary()), counts, pa.array([decoded(x, tokens) for x in ids], pa.string())]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *made], names=schema.names)

        return docs.mapInArrow(run, schema)


def decoded(ids: bytes | None, tokens: list[str | None]) -> str:
    """The tokens of packed ids, joined by spaces."""
    found = np.frombuffer(ids or b"", "<u4")
    if len(found) and int(found.max()) >= len(tokens):
        found = found[found < len(tokens)]
    return " ".join([t for t in map(tokens.__getitem__, found.tolist()) if t is not None])


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of longs."""
    at = F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int"))
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k, F.lit(1))), 16, 10).cast("long")
    value = lambda i: sum((byte(i, k + 1) * 256**k for k in range(4)), F.lit(0).cast("long"))
    return F.when(F.octet_length(ids) >= 4, F.transform(at, value)).otherwise(F.array().cast("array<bigint>"))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids (packed), n_tokens and decoded, in place of columns of these names."""
    return Bpe(docs.sparkSession, path).both(docs)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
