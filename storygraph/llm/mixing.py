"""Mixing sources to target weights, with DataFrame operations alone.

The words of a source, its documents one after the other, are packed into blocks of BLOCK words; what is left over is its tail, a last
shorter block. Output shards of SHARD slots draw a multinomial number of slots for each source; the slots of a source are numbered across
the shards in a pseudorandom order, and a keyed pseudorandom permutation of the source's blocks, another in each epoch, turns a slot's
number into a block, which is joined by its index. Slots beyond a source's quota are dropped, wherever they are, and the ones it lacks are
made up in pseudorandom shards. An epoch takes all blocks and the tail; the last, unfinished epoch takes whole blocks and, in its last
slot, as many words of one more block (or of the tail) as the target lacks. So each source meets its target to half a word, and no
word is taken more than ceil(target / size) times, which is at most MOST.

Defined cases: a null text has no words (size 0, taken 0); a null source is a source of its own, the last; rows that repeat are
documents of their own; null doc_ids are allowed; an empty table, or one without words, gives taken 0 for each row.
All draws are hashes of (SEED, numbers), so reruns and lost executors give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storygraph.llm.common import n_words, once, prefix_sum, stored, unwrapped, words, wrapped

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK, SHARD = 512, 1024
SEED = 20
#: Parts of (0, 1) by which draws are joined with the sources' shares, chunks of prefix sums, rounds of the permutation; slots made up at once.
PARTS, CHUNKS, ROUNDS, MADE = 4096, 4096, 24, 1024


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size), a row for each source, gets sid (0, 1, ...) and target.

    Shares follow the weights; a share above most * source_size stops there and the rest is shared anew by weight. With caps in the
    order of cap / weight, the sources before the first one that the remaining level does not fill are at their caps.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = Window.orderBy("_full", "sid")
    capped = (
        sources.withColumn("sid", F.row_number().over(order) - 1)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_full", F.col("_cap") / F.col("_weight"))
    )
    total, all_rows = F.sum("source_size").over(Window.partitionBy()), Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("_level", (total - before) / left)
    level = F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(all_rows)
    return levels.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("_weight"))).select(
        "source", "sid", F.col("source_size").cast("long"), F.col("target").cast("double")
    )


def with_blocks(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds what the mix takes of each source: n_full blocks and perhaps a tail make the n_slots of an epoch; epochs are whole, `more`
    blocks follow, and `part` words of one more. quota is the number of slots of all that."""
    size = F.col("source_size")
    words_ = F.round("target").cast("long")
    out = sources.withColumn("block_len", F.lit(block).cast("long")).withColumn("n_full", F.floor(size / block))
    out = out.withColumn("n_slots", F.col("n_full") + (size % block > 0).cast("long"))
    out = out.withColumn("epochs", F.when(size > 0, F.floor(words_ / size)).otherwise(0).cast("long"))
    rest = F.when(size > 0, words_ - F.col("epochs") * size).otherwise(0)
    out = out.withColumn("more", F.floor(rest / block)).withColumn("part", (rest % block).cast("long"))
    return out.withColumn("quota", F.col("epochs") * F.col("n_slots") + F.col("more") + (F.col("part") > 0).cast("long"))


def permuted(x: Column, n: Column, *keys: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 for each value of the keys, at x: swap-or-not rounds, a bijection for every n."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - at, n)
        return once(other, lambda o: F.when(F.xxhash64(*keys, r, F.greatest(at, o), F.lit("swap")) % 2 == 0, o).otherwise(at))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def _draws(sources: DataFrame, n: int, shard: int, seed: int) -> DataFrame:
    """(sid, shard, slot): the source that each of n slots draws, by the sources' shares of all quotas."""
    slots = sources.sparkSession.range(-(-n // shard)).withColumnRenamed("id", "shard")
    slots = slots.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard), n - F.col("shard") * shard) - 1)).alias("slot"))
    slots = slots.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "shard", "slot"), 11) / F.lit(float(2**53)))
    by = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    share = sources.filter("quota > 0").withColumn("_to", F.sum("quota").over(by) / F.sum("quota").over(Window.partitionBy()))
    share = share.withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy("sid")), F.lit(0.0)))
    part = lambda u: F.least(F.lit(PARTS - 1), F.floor(u * PARTS)).cast("long")
    share = share.select("sid", "_from", "_to", F.explode(F.sequence(part(F.col("_from")), part(F.col("_to")))).alias("_part"))
    slots = slots.withColumn("_part", part(F.col("_u")))
    drawn = slots.join(share, (slots["_part"] == share["_part"]) & (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
    return drawn.select("sid", "shard", "slot")


def plan(sources: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, sid, epoch, block, cut): the mix; cut: how many words of a block are taken, null for all of it.

    sources: with_blocks(), a few columns for each source. The driver sees the number of slots.
    """
    n = sources.agg(F.sum("quota")).first()[0] or 0
    drawn = _draws(sources, n, shard, seed).withColumn("_h", F.xxhash64(F.lit(seed), "sid", "shard", "slot", F.lit("order")))
    drawn = drawn.withColumn("_chunk", F.pmod("_h", F.lit(CHUNKS))).withColumn("_one", F.lit(1).cast("long"))
    numbered = prefix_sum(drawn, ["sid"], "_chunk", ["_h", "shard", "slot"], "_one", "_j").select("sid", "shard", "slot", "_j")

    have = drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("_have"))
    short = sources.join(have, "sid", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_have < quota")
    runs = F.explode(F.sequence(F.col("_have").cast("long"), F.col("quota") - 1, F.lit(MADE).cast("long")))
    short = short.select("sid", "quota", runs.alias("_run")).repartition("sid", "_run")
    short = short.select("sid", F.explode(F.sequence(F.col("_run"), F.least(F.col("quota"), F.col("_run") + MADE) - 1)).alias("_j"))
    made_up = short.select("sid", F.pmod(F.xxhash64(F.lit(seed), "sid", "_j"), F.lit(max(1, -(-n // shard)))).alias("shard"), (shard + F.col("_j")).alias("slot"), "_j")
    slots = numbered.unionByName(made_up).join(sources.select("sid", "quota", "n_full", "n_slots", "epochs", "more", "part"), "sid").filter("_j < quota")
    slots = slots.withColumn("epoch", F.floor(F.col("_j") / F.col("n_slots")))
    slots = slots.withColumn("_at", F.col("_j") - F.col("epoch") * F.col("n_slots"))
    whole = permuted(F.col("_at"), F.greatest(F.lit(1), F.col("n_full")), F.lit(seed), F.col("sid"), F.col("epoch"))
    block = F.when(F.col("_at") < F.col("n_full"), whole).otherwise(F.col("n_full"))
    last = (F.col("epoch") == F.col("epochs")) & (F.col("_at") == F.col("more"))
    return slots.select("shard", "slot", "sid", "epoch", block.alias("block"), F.when(last, F.col("part")).alias("cut"))


def sized(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both in the shared folder: documents (doc_id, n, sid, size, offset, block_len, ...) without their texts, and the sources."""
    rows = docs.select("doc_id", "source", *[c for c in docs.columns if c.startswith("_key")], n_words(F.col("text")).alias("size"))
    rows = stored(rows, "mix-sizes")
    sources = with_blocks(with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    sources = stored(sources, "mix-sources", "uncompressed")
    # A few bytes for each source: Spark broadcasts it if its files are below spark.sql.autoBroadcastJoinThreshold, else it shuffles.
    by = sources.withColumnRenamed("source", "_source")
    rows = rows.join(by, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(CHUNKS)))
    keys = [c for c in rows.columns if c.startswith("_key")]
    return prefix_sum(rows, ["sid"], "_chunk", ["doc_id", "size", *keys], "size", "offset").drop("_chunk"), sources


def pieces(rows: DataFrame) -> DataFrame:
    """A row for each document and block that it lies in, with start and end, the words of the document that the block holds."""
    b = F.col("block_len")
    first, last = F.floor(F.col("offset") / b), F.floor((F.col("offset") + F.col("size") - 1) / b)
    out = rows.filter("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * b - F.col("offset"))
    end = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("offset"))
    return out.withColumn("start", start).withColumn("end", end)


def _within_cut() -> Column:
    """How many words of a piece are among the first `cut` ones of its block; null without a cut."""
    before = F.col("offset") + F.col("start") - F.col("block") * F.col("block_len")
    return F.when(F.col("cut").isNotNull(), F.greatest(F.lit(0), F.least(F.col("end") - F.col("start"), F.col("cut") - before)))


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs."""
    rows, sources = sized(docs)
    uses = plan(sources).groupBy("sid", "block").agg(F.sum(F.col("cut").isNull().cast("long")).alias("uses"), F.max("cut").alias("cut"))
    keys = ["sid", "offset", "doc_id", "source", "size", "source_size", "target"]
    have = pieces(rows).join(uses.hint("merge"), ["sid", "block"], "left")
    got = F.coalesce("uses", F.lit(0)) * (F.col("end") - F.col("start")) + F.coalesce(_within_cut(), F.lit(0))
    have = have.groupBy(*keys).agg(F.sum(got).alias("taken"))
    none = rows.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return have.unionByName(none).drop("sid", "offset")


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each document and epoch that takes any of its words, text being what is taken.

    A document that an epoch takes whole keeps its text as it is; of others, the words taken are joined by spaces, in order.
    """
    body = F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64("doc_id", "source", body).alias("_key1"), F.xxhash64(body, "doc_id", F.lit("row")).alias("_key2")]
    nth = lambda *by: F.row_number().over(Window.partitionBy("_key1", "_key2", *by).orderBy("_key1"))  # noqa: E731  # rows that repeat are alike
    keyed = wrapped(docs, "doc_id", "source", "text").select("*", *hashes)
    rows, sources = sized(keyed.select("doc_id", "source", "text", "_key1", "_key2"))
    rows = rows.select("*", nth().alias("_key3"))
    got = pieces(rows).join(plan(sources).select("sid", "block", "epoch", "cut").hint("merge"), ["sid", "block"])
    got = got.withColumn("end", F.when(F.col("cut").isNull(), F.col("end")).otherwise(F.col("start") + _within_cut())).filter("end > start")
    keys = ["_key1", "_key2", "_key3"]
    got = got.groupBy(*keys, "epoch", "size").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"),  # bounded by the document's own length
        F.sum(F.col("end") - F.col("start")).alias("_got"),
    )
    got = got.groupBy(*keys, "size").agg(F.collect_list(F.struct("epoch", "_spans", "_got")).alias("_epochs"))  # at most MOST
    # Documents, which hold their text once, and what is taken of them are shuffled together: a join on the three keys would shuffle the
    # texts again, as numbering rows that repeat deals them by two.
    met = keyed.select("_doc", "_key1", "_key2").unionByName(got.select(*keys, F.struct("size", "_epochs").alias("_taken")), allowMissingColumns=True)
    met = met.repartition("_key1", "_key2").withColumn("_key3", F.coalesce("_key3", nth(F.col("_doc").isNull())))
    met = met.withColumn("_taken", F.first("_taken", ignorenulls=True).over(Window.partitionBy(*keys)))  # one of each key at most
    out = met.filter("_doc IS NOT NULL").select("_doc", "_taken.size", F.explode("_taken._epochs").alias("_e")).withColumn("text", F.col("_doc").getField("text"))
    cut = F.flatten(F.transform("_e._spans", lambda s: F.slice(F.col("_words"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    out = out.withColumn("_words", F.when(F.col("_e._got") < F.col("size"), words(F.col("text"))))
    out = out.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(F.array_join(cut, " ")))
    return unwrapped(out, docs.columns, "text")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return taken(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
