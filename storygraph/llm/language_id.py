"""Language ID by n-gram filters with language bitmasks.

A bit-sliced Bloom filter: SLOTS rows of bits, one bit for each language, in words of 64. An n-gram has HASHES slots, and the AND of their
rows is the set of all languages whose filter holds it, in one look-up for each 64 languages. A text's n-grams are looked up all;
the share of them that a language holds, corrected for the share that a filter so full would hold by chance, is its score, and the
largest decides.

What is learned: the n-grams that at least LEAST_SHARE of a language's documents hold, if that share is also OFTEN times
the mean of the languages' shares. It is learned from a sample of at most about SAMPLE documents for each language, the ones of least hash; the filter's size is fixed.

Defined cases: a text that is null or has no letter is `und` with score 0; a null doc_id isn't learned from and isn't held out; with
no language to learn every text is `und`; any number of languages is learned; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storygraph.llm.common import mix

SIZES = (2, 3, 4)
SLOTS, HASHES = 1 << 19, 3
SAMPLE, LEAST_SHARE, OFTEN = 1500, 0.01, 1.5
#: Languages in a word of a mask.
WORD = 64
U = np.uint64
_own: dict = {}


def grams(text: str | None) -> np.ndarray:
    """Hashes of the n-grams of a text's lower-case letters; runs of other characters count as one blank."""
    if not text:
        return np.empty(0, U)
    if "letters" not in _own:
        _own["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _own["letters"][code]
    if not letter.any():
        return np.empty(0, U)
    code = np.concatenate([[0], np.where(letter, code, 0), [0]]).astype(U)
    code = code[np.concatenate([[True], (code[1:] > 0) | (code[:-1] > 0)])]
    out = []
    for n in SIZES:
        size = len(code) - n + 1
        if size > 0:
            h = np.full(size, n, U)
            for i in range(n):
                h = h * U(0x110001) + code[i : i + size]
            out.append(h)
    return mix(np.concatenate(out))


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> U(20 * i)) & U(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def languages(docs: DataFrame) -> list[tuple[str, int]]:
    """The languages to learn, with their numbers of documents: a row for each."""
    rows = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["lang"], r["n"]) for r in rows)


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and the filter. docs: (doc_id, text, lang) to learn from."""
    docs = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    known = languages(docs)
    names = [x for x, _ in known]
    if not names:
        return [], empty_filter(0)
    share = F.create_map(*[c for x, n in known for c in (F.lit(x), F.lit(min(1.0, sample / n)))])
    number = F.create_map(*[c for i, x in enumerate(names) for c in (F.lit(x), F.lit(i))])
    drawn = docs.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / F.lit(float(2**53)) < F.try_element_at(share, "lang"))
    drawn = drawn.select(F.try_element_at(number, "lang").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by language and n-gram, added up for each batch; gram 0 counts the documents."""
        for batch in batches:
            of = [np.unique(np.append(grams(x), U(0))) for x in batch.column(1).to_pylist()]
            lang = np.repeat(np.array(batch.column(0).to_pylist(), np.int32), [len(g) for g in of]) if of else np.empty(0, np.int32)
            frame = pd.DataFrame({"lang": lang, "gram": np.concatenate(of).view(np.int64) if of else np.empty(0, np.int64)})
            sums = frame.value_counts().reset_index(name="n")
            yield pa.RecordBatch.from_pandas(sums.astype({"lang": "int32", "gram": "int64", "n": "int64"}), preserve_index=False)

    counts = drawn.mapInArrow(count, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("e"))  # as many as there are languages
    totals = {r["lang"]: r["n"] for r in counts.filter("gram = 0").collect()}
    if not totals:
        return names, empty_filter(len(names))
    total = F.create_map(*[c for i, n in totals.items() for c in (F.lit(i), F.lit(n))])
    rate = lambda x: x["n"] / F.try_element_at(total, x["lang"])
    mean = F.aggregate("e", F.lit(0.0), lambda s, x: s + rate(x)) / len(totals)
    often = lambda x: (rate(x) >= LEAST_SHARE) & (rate(x) >= OFTEN * F.col("mean"))
    held = by_gram.filter("gram != 0").withColumn("mean", mean).select("gram", F.explode(F.filter("e", often)["lang"]).alias("lang"))
    place = F.explode(F.array(*[F.shiftrightunsigned("gram", 20 * i).bitwiseAND(F.lit(SLOTS - 1)) for i in range(HASHES)]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lang") % WORD)
    words = held.select(place.alias("slot"), F.floor(F.col("lang") / WORD).alias("word"), bit.alias("bit"))
    table = words.groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toPandas()  # SLOTS rows for each 64 languages at most
    filter_ = empty_filter(len(names))
    filter_[table["slot"].to_numpy(np.int64), table["word"].to_numpy(np.int64)] = table["mask"].to_numpy(np.int64).view(U)
    return names, filter_


def empty_filter(n: int) -> np.ndarray:
    return np.zeros((SLOTS, max(1, -(-n // WORD))), U)


def counts(masks: np.ndarray, n: int) -> np.ndarray:
    """How many of the masks have each of n languages."""
    return np.array([np.count_nonzero(masks[:, i // WORD] & U(1 << i % WORD)) for i in range(n)])


def scores(h: np.ndarray, filter_: np.ndarray, n: int, chance: np.ndarray) -> np.ndarray:
    """The corrected share of n-grams for each of n languages."""
    first, *others = slots(h)
    masks = filter_[first]
    for s in others:
        masks &= filter_[s]
    held = counts(masks, n) / len(h)
    return np.clip((held - chance) / np.maximum(1e-9, 1 - chance), 0, 1)


def predict(docs: DataFrame, names: list[str], filter_: np.ndarray) -> DataFrame:
    """docs without text, with lang_pred and score."""
    model = docs.sparkSession.sparkContext.broadcast(filter_)  # 8 bytes for each of SLOTS slots and 64 languages
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    schema = T.StructType([f for f in docs.schema if f.name != "text"]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = model.value
        full = counts(filter_, len(names)) / SLOTS
        for batch in batches:
            pred, score = [], []
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(at).slice(start, 256).to_pylist():
                    h = grams(text)
                    s = scores(h, filter_, len(names), full**HASHES) if len(h) and names else None
                    pred.append("und" if s is None else names[int(s.argmax())])
                    score.append(0.0 if s is None else float(s.max()))
            keep = [(c, n) for i, (c, n) in enumerate(zip(batch.columns, batch.schema.names, strict=True)) if i != at]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*(n for _, n in keep), "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    names, filter_ = learn(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), names, filter_)
