"""Corpus analytics: canonical entities, presence, co-occurrence, trajectories, frequencies. Works are stories of a corpus.

entities: (story, story_ord, ord, id, type, label); mentions: (story, story_ord, entity, section, mention_count, sentence_ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storygraph.functions import text as X
from storygraph.operators.graph import union
from storygraph.operators.ranking import numbered
from storygraph.schemas import ENTITY_TYPES


def with_key(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with key; aliases: (key, canonical), for characters alone."""
    raw = entities.withColumn("_raw", X.raw_key(F.col("id")))
    joined = raw.join(aliases.select(F.col("key").alias("_raw"), "canonical"), "_raw", "left")
    key = F.when(F.col("type") != "character", F.concat_ws(":", "type", "_raw")).otherwise(F.coalesce("canonical", "_raw"))
    return joined.withColumn("key", key).drop("_raw", "canonical")


def keyed_mentions(mentions: DataFrame, keyed: DataFrame) -> DataFrame:
    """Mentions of known entities with key and type; of entities that share an id the first counts."""
    first = keyed.groupBy("story", "id").agg(F.min_by(F.struct("key", "type", "label"), "ord").alias("e")).select("story", F.col("id").alias("entity"), "e.*")
    return mentions.join(first, ["story", "entity"])


def work_summaries(works: DataFrame, sections: DataFrame, sentences: DataFrame, entities: DataFrame, mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Each table is counted by story before anything is joined."""
    n = F.count(F.lit(1))
    parts = [
        sections.groupBy("story").agg(n.alias("section_count"), F.sum("word_count").alias("word_count")),
        sentences.groupBy("story").agg(n.alias("sentence_count")),
        entities.groupBy("story").agg(n.alias("entity_count")),
        mentions.groupBy("story").agg(F.sum("mention_count").alias("mention_count")),
        events.groupBy("story").agg(n.alias("event_count")),
    ]
    out = works
    for p in parts:
        out = out.join(p, "story", "left")
    return out.fillna(0)


def entity_summaries(keyed: DataFrame, keyed_mentions_: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """C4: (key, label, type, total_mentions, works, seen); seen orders the keys as they are first met. preferred: (key, preferred)."""
    order = F.struct("story_ord", "ord")
    label = F.max_by("label", F.struct(F.length("label"), -F.col("story_ord"), -F.col("ord")))
    keys = keyed.groupBy("key").agg(X.pretty_label(label).alias("label"), F.min_by("type", order).alias("type"), F.min(order).alias("seen"))
    by_work = keyed_mentions_.groupBy("key", "story").agg(F.sum("mention_count").alias("n"))
    sums = by_work.groupBy("key").agg(F.sum("n").alias("total_mentions"), F.array_sort(F.collect_set("story")).alias("works"))  # as many as there are works
    out = keys.join(sums, "key", "left").withColumn("total_mentions", F.coalesce("total_mentions", F.lit(0).cast("long"))).withColumn("works", F.coalesce("works", F.array().cast("array<string>")))
    if preferred is not None:
        out = out.join(preferred, "key", "left").withColumn("label", F.coalesce("preferred", "label")).drop("preferred")
    return out


def raw_ids(keyed: DataFrame) -> DataFrame:
    """C5."""
    return keyed.groupBy("key", "story").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("raw_ids"))


def with_fraction(sentences: DataFrame) -> DataFrame:
    """Sentences with fraction, their place in the story from 0 to 1."""
    total = sentences.groupBy("story").agg(F.count(F.lit(1)).alias("_total"))
    at = F.when(F.col("_total") > 1, F.col("position") / (F.col("_total") - 1)).otherwise(0.0)
    return sentences.join(F.broadcast(total), "story").withColumn("fraction", at).drop("_total")  # a row for each work


def presence(keyed_mentions_: DataFrame, sentences: DataFrame) -> DataFrame:
    """A row for each cited sentence that exists; the join is on (story, sentence), which spreads a frequent entity."""
    cited = keyed_mentions_.select("key", "type", "story", F.explode("sentence_ids").alias("id"))
    return cited.join(with_fraction(sentences).select("story", "id", "fraction", "text", "position"), ["story", "id"])


def searchable(sentences: DataFrame, shortest: int = 4) -> DataFrame:
    """C7."""
    return with_fraction(sentences).filter(F.length("text") >= shortest)


def search(sentences: DataFrame, query: str, most: int = 50) -> DataFrame:
    """The first sentences, in corpus order, that contain the query; none for a query under 2 letters."""
    q = query.strip().lower()
    hits = sentences.filter(F.lower("text").contains(q) & F.lit(len(q) >= 2))
    return hits.orderBy("story_ord", "position").limit(most)


def scoreboard(sentences: DataFrame, phrases: list[str]) -> DataFrame:
    """The number of sentences that hold each phrase, in one scan."""
    held = sentences.agg(*[F.sum(F.lower("text").contains(p.lower()).cast("int")).alias(str(i)) for i, p in enumerate(phrases)])
    pairs = F.array(*[F.struct(F.lit(p).alias("phrase"), F.coalesce(F.col(str(i)), F.lit(0)).alias("n")) for i, p in enumerate(phrases)])
    return held.select(F.explode(pairs).alias("p")).select("p.*")


def top_keys(summaries: DataFrame, type_: str, most: int) -> DataFrame:
    """The keys of a type with most mentions; a few rows by construction."""
    return summaries.filter(F.col("type") == type_).orderBy(F.desc("total_mentions"), "seen").limit(most).select("key")


def co_occurrence(keyed_mentions_: DataFrame, summaries: DataFrame, most: int = 40) -> DataFrame:
    """In how many sections each two of the top characters are both mentioned. At most `most` keys are paired in a section."""
    top = top_keys(summaries, "character", most)
    own = keyed_mentions_.join(top, "key", "left_semi").select("story", "section", "key").distinct()
    sets = own.groupBy("story", "section").agg(F.array_sort(F.collect_list("key")).alias("keys")).filter(F.size("keys") > 1)
    pair = sets.select(F.posexplode("keys").alias("i", "a"), "keys").select("a", F.explode(F.slice(F.col("keys"), F.col("i") + 2, F.size("keys"))).alias("b"))
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def network(edges: DataFrame, summaries: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """C11: edges of a minimum weight, and the nodes that remain."""
    kept = edges.filter(F.col("weight") >= least)
    ends = kept.select(F.col("a").alias("key")).unionByName(kept.select(F.col("b").alias("key"))).distinct()
    return kept, summaries.join(ends, "key").select("key", "label", "total_mentions")


def trajectories(events: DataFrame, entities: DataFrame, states: DataFrame) -> DataFrame:
    """Where each character is, from event index to event index. events: (story, id, section); states: (story, from, to, type,
    valid_from, valid_until) by event ids. Events go by section and id, as strings; of entities that share an id the last counts."""
    by = Window.partitionBy("story").orderBy("section", "id")
    e = events.select("story", "id", (F.row_number().over(by) - 1).alias("i"))
    count = events.groupBy("story").agg(F.count(F.lit(1)).alias("_all"))
    last = entities.groupBy("story", "id").agg(F.max_by(F.struct("type", "label"), "ord").alias("e")) if "ord" in entities.columns else entities.select("story", "id", F.struct("type", "label").alias("e"))
    s = states.filter("type = 'LOCATED_AT'")
    s = s.join(last.select("story", F.col("id").alias("from"), F.col("e").alias("c")), ["story", "from"]).join(last.select("story", F.col("id").alias("to"), F.col("e").alias("l")), ["story", "to"])
    s = s.filter("c.type = 'character' AND l.type = 'location'").join(count, "story")
    s = s.join(e.select("story", F.col("id").alias("valid_from"), F.col("i").alias("start")), ["story", "valid_from"])
    s = s.join(e.select("story", F.col("id").alias("valid_until"), F.col("i").alias("stop")), ["story", "valid_until"], "left")
    s = s.withColumn("stop", F.when(F.coalesce(F.col("valid_until"), F.lit("")) == "", F.col("_all")).otherwise(F.col("stop"))).filter("stop IS NOT NULL")
    return s.select("story", F.col("from").alias("character"), X.pretty_label(F.col("c.label")).alias("label"), F.col("to").alias("location"), F.col("start").cast("long").alias("start"), F.greatest("stop", F.col("start") + 1).cast("long").alias("stop"))


def tracks(segments: DataFrame, pinned: list[str], most: int = 8) -> DataFrame:
    """The characters of each story with most segments, pinned ones first."""
    n = segments.groupBy("story", "character").agg(F.count(F.lit(1)).alias("segments"), F.min("start").alias("first"))
    pin = F.coalesce(F.array_position(F.array(*map(F.lit, pinned)), F.col("character")), F.lit(0)) if pinned else F.lit(0)
    by = Window.partitionBy("story").orderBy(F.when(pin > 0, pin).otherwise(len(pinned) + 1), F.desc("segments"), "character")
    return n.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def frequency(summaries: DataFrame, most: int = 60) -> DataFrame:
    """C14: the top entities of each type in a fixed order of types, with the total of these."""
    by = Window.partitionBy("type").orderBy(F.desc("total_mentions"), "seen")
    top = summaries.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)
    return top.filter(F.col("type").isin(*ENTITY_TYPES)).select(
        (F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), F.col("type")) - 1).cast("int").alias("type_ord"), "type", "rank", "key", "label", F.col("total_mentions").alias("count"),
        F.size("works").alias("works"), F.sum("total_mentions").over(Window.partitionBy("type")).alias("type_total"),
    )


def presence_payload(presence_: DataFrame, summaries: DataFrame, least: int = 2, most: int = 60) -> DataFrame:
    """C15."""
    top = top_keys(summaries.filter(F.col("total_mentions") >= least), "character", most)
    return presence_.join(top, "key", "left_semi").select("key", "story", (F.floor(F.col("fraction") * 1e4 + 0.5) / 1e4).alias("fraction"), "position", X.cut(F.col("text"), 140, 139).alias("text"))


def presence_totals(presence_: DataFrame) -> DataFrame:
    """C16."""
    return presence_.groupBy("key").agg(F.count(F.lit(1)).alias("marks"), F.countDistinct("story").alias("works"))


def long_tail(summaries: DataFrame) -> DataFrame:
    """C17: rank by mentions within each type, and over all (type "all"); entities without mentions are left out."""
    counted = summaries.filter("total_mentions > 0")
    all_ = counted.select(F.lit("all").alias("type"), "key", "total_mentions", "seen").unionByName(counted.select("type", "key", "total_mentions", "seen"))
    # Most entities have few mentions, so those of one number are taken story by story.
    ranked = numbered(all_, ["type"], [-F.col("total_mentions"), F.col("seen.story_ord")], [F.col("seen")], "rank")
    return ranked.select("type", "key", F.col("total_mentions").alias("count"), "rank")


def tail_summary(ranks: DataFrame) -> DataFrame:
    """C18."""
    few = F.col("count") <= 2
    out = ranks.groupBy("type").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rank") <= 10, F.col("count")).otherwise(0)).alias("top10"), F.sum(few.cast("int")).alias("few"))
    return out.select("type", "total", "n", (F.col("top10") / F.col("total")).alias("top10_share"), "few", (F.col("few") / F.col("n")).alias("few_share"))


def density(summaries: DataFrame) -> DataFrame:
    """Of work summaries; counts per 1,000 words, 0 for a work without words."""
    per = lambda c: F.when(F.col("word_count") > 0, F.col(c) * 1000 / F.col("word_count")).otherwise(0.0)
    out = summaries.select("story", *[per(f"{c}_count").alias(f"{c}_density") for c in ("entity", "event", "mention")], (F.col("entity_count") + F.col("event_count") + F.col("mention_count")).alias("stack"))
    return out.withColumn("largest", F.max("stack").over(Window.partitionBy()))  # a row for each work


def funnel(work_summaries_: DataFrame, frequency_: DataFrame) -> DataFrame:
    """C20: (stage, n)."""
    c = work_summaries_.agg(F.count(F.lit(1)).alias("books"), *[F.sum(f"{x}_count").alias(f"{x}s") for x in ("section", "sentence", "entity", "event", "mention")])
    c = c.join(F.broadcast(frequency_.agg(F.sum((F.col("type") == "case").cast("int")).alias("cases"))))  # one row each
    names = ("books", "sections", "sentences", "entitys", "events", "mentions", "cases")
    return c.select(F.explode(F.array(*[F.struct(F.lit("entities" if x == "entitys" else x).alias("stage"), F.coalesce(F.col(x), F.lit(0)).cast("long").alias("n")) for x in names])).alias("s")).select("s.*")


def naming(mentions: DataFrame, sentences: DataFrame, pattern: str) -> DataFrame:
    """Sentences that name an entity of a group (by a pattern for ids), with a snippet, and how many there are."""
    cited = mentions.filter(F.col("entity").rlike(pattern)).select("story", F.explode("sentence_ids").alias("id")).distinct()
    hits = sentences.join(cited, ["story", "id"], "left_semi")
    return hits.select("story", "id", X.cut(F.col("text"), 90, 87).alias("snippet"))


def appearances(mentions: DataFrame, pattern: str) -> DataFrame:
    """C22."""
    return mentions.filter(F.col("entity").rlike(pattern)).groupBy("story").agg(F.sum(F.size("sentence_ids")).alias("n")).filter("n > 0")


def shared_sections(mentions: DataFrame, a: str, b: str) -> DataFrame:
    """By story, the sections where both groups are mentioned; one pass instead of a self-join."""
    per = mentions.groupBy("story", "section").agg(F.bool_or(F.col("entity").rlike(a)).alias("a"), F.bool_or(F.col("entity").rlike(b)).alias("b"))
    return per.filter("a AND b").groupBy("story").agg(F.count(F.lit(1)).alias("n"))


def of_section(mentions: DataFrame, entities: DataFrame, sections: DataFrame) -> DataFrame:
    """The distinct entities mentioned in each of the sections (story, section)."""
    m = mentions.join(sections, ["story", "section"], "left_semi").select("story", "section", F.col("entity").alias("id")).distinct()
    return m.join(entities.select("story", "id", "type", "label"), ["story", "id"]).select("story", "section", "id", "type", "label").distinct()


def variants(entities: DataFrame, pattern: str) -> DataFrame:
    """C25."""
    return entities.filter(F.col("id").rlike(pattern)).select("id").distinct().orderBy("id")


def passage(sentences: DataFrame, mentions: DataFrame, events: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
    """Sentences i..j of each story of spans (story, i, j), with the entities of each sentence, the events that cite any of them
    (their sources cut to the passage), and the entities used."""
    s = sentences.join(spans, "story").filter("position BETWEEN i AND j").select("story", "id", "position", "text")
    named = mentions.select("story", "entity", F.explode("sentence_ids").alias("id")).distinct().join(s.select("story", "id"), ["story", "id"], "left_semi")
    sets = named.groupBy("story", "id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    cited = events.select("story", F.col("id").alias("event"), F.posexplode("source_nodes").alias("k", "id")).join(s.select("story", "id"), ["story", "id"], "left_semi")
    cut = cited.groupBy("story", "event").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("source_nodes"))
    parts = events.select("story", F.col("id").alias("event"), F.explode("participants").alias("entity")).join(cut.select("story", "event"), ["story", "event"], "left_semi")
    return {
        "sentences": s.join(sets, ["story", "id"], "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))),
        "events": cut,
        "entities": named.select("story", "entity").unionByName(parts.select("story", "entity")).distinct(),
    }


def labelled_clues(clues: DataFrame, entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """Clues (story, ord, object, case, discovered_by, source_nodes) with labels (an id without one stands for itself) and the cited
    sentences as texts, missing ones left out."""
    out = clues
    for c in ("object", "case", "discovered_by"):
        out = out.join(entities.select("story", F.col("id").alias(c), F.col("label").alias(f"{c}_label")), ["story", c], "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    cited = clues.select("story", "ord", F.posexplode("source_nodes").alias("k", "id")).join(sentences.select("story", "id", "text"), ["story", "id"])
    texts = cited.groupBy("story", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("texts"))
    return out.join(texts, ["story", "ord"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def tagged(sentences: DataFrame, labels: DataFrame) -> DataFrame:
    """(story, id, segments). labels: (story, id, ord, entity, type, label), the entities of each sentence. Longer labels win, case
    (of any script) doesn't count, a label's short form without honorific counts too, and of equal labels the later entity is meant."""
    short = F.regexp_replace("label", X.SPAN_HONORIFIC, "")
    forms = F.array(F.struct(F.lit(0).alias("n"), F.col("label").alias("form")), F.struct(F.lit(1).alias("n"), short.alias("form")))
    each = labels.repartition("story", "id").select("story", "id", "ord", "entity", "type", "label", F.explode(forms).alias("f")).filter("f.n = 0 OR (f.form != label AND length(f.form) > 2)")
    each = each.filter(F.col("f.form") != "").select("story", "id", F.struct("ord", "f.n").alias("at"), F.lower("f.form").alias("form"), "entity", "type")
    meant = each.groupBy("story", "id", "form").agg(F.max_by(F.struct("entity", "type"), "at").alias("e"))
    quoted = F.regexp_replace("form", r"([.*+?^${}()|\[\]\\])", r"\\$1")
    sets = meant.groupBy("story", "id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("form")).alias("n"), quoted.alias("q")))), lambda x: x["q"]), "|").alias("_any"),
        F.map_from_entries(F.collect_list(F.struct("form", "e"))).alias("_of"),
    )
    s = sentences.select("story", "id", "text").join(sets, ["story", "id"], "left")
    pattern = F.concat(F.lit("(?iu)(?:"), F.col("_any"), F.lit(")"))
    none = F.lit(None).cast("string")
    plain = lambda t: F.struct(t.alias("text"), none.alias("entity"), none.alias("type"))
    hit = lambda t: F.struct(t.alias("text"), F.try_element_at("_of", F.lower(t))["entity"].alias("entity"), F.try_element_at("_of", F.lower(t))["type"].alias("type"))
    zipped = F.arrays_zip(F.split("text", pattern, -1).alias("a"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("b"))
    pairs = F.flatten(F.transform(zipped, lambda z: F.array(plain(F.coalesce(z["a"], F.lit(""))), hit(F.coalesce(z["b"], F.lit(""))))))
    return s.select("story", "id", F.when(F.col("_any").isNull(), F.array(plain(F.col("text")))).otherwise(F.filter(pairs, lambda x: x["text"] != "")).alias("segments"))


def citations(events: DataFrame, mentions: DataFrame) -> DataFrame:
    """(story, kind, key, ids): events by cited sentence, and sentences by entity."""
    a = events.select("story", F.lit("sentence").alias("kind"), F.explode("source_nodes").alias("key"), "id")
    b = mentions.select("story", F.lit("entity").alias("kind"), F.col("entity").alias("key"), F.explode("sentence_ids").alias("id"))
    return union([a, b]).groupBy("story", "kind", "key").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def raw_variants(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every entity of every story with its raw key and its mentions."""
    n = mentions.groupBy("story", F.col("entity").alias("id")).agg(F.sum("mention_count").alias("mentions"))
    return entities.join(n, ["story", "id"], "left").select("story", "id", "label", "type", X.raw_key(F.col("id")).alias("raw"), F.coalesce("mentions", F.lit(0)).alias("mentions"))

