"""Q8, Q9 through chains of telling: when a character could first know of an event, what they then believe to hold, and where they are wrong.

A telling passes on the event told of, and with it all that the speaker knew before. Times are numbers: `times` gives each event of a story
its number in the story's order, from 1. Nothing is known by inference or assumption.

The contacts of a story are a graph whose points are (character, time at which they learn something) and whose arrows lead to the first
telling after that time, for each recipient. What is learned at a point goes the same ways whatever it is, so a story is read once, from
its end: after each event a table holds when what a character knows by then reaches each other one, and a telling changes the row of its
speaker alone (`earliest`). What is believed needs no list of what is known: a belief is the newest thing heard, so a story is read once,
from its start, and a telling hands on what is newest for its speaker (`states`). Each pass sorts a story's events on disk and holds, of one
story at a time, a number for each two characters, or two statements for each character and state; time grows with events and what is returned.

Defined cases: a participant knows an event at once, and so do recipients of what is told in it; a speaker need not take part in the event
to be its speaker; a null speaker tells only the event itself; null participants and recipients do not count; equal places of two events
are told apart by their ids; empty tables give empty results; other columns of events are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storygraph.operators.intervals import interval_join
from storygraph.operators.ranking import numbered

#: A character's knowledge of an event.
FACT = ["story", "event", "character"]


def times(events: DataFrame, sections: DataFrame) -> DataFrame:
    """events (story, id, section, ord, ...) as (story, event, pos, t): pos the index of its section (0 where unknown), t its number in the story."""
    s = sections.select("story", "section", F.col("idx").alias("pos"))
    e = events.select("story", F.col("id").alias("event"), "section", "ord").join(s, ["story", "section"], "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    return numbered(e, ["story"], [F.col("pos")], [F.col("ord"), F.col("event")], "t").select("story", "event", "pos", "t")


def _each(events: DataFrame, values: Column) -> DataFrame:
    """(story, event, t, character): a row for each of an event's values."""
    out = events.select("story", "event", "t", F.explode(F.array_distinct(values)).alias("character"))
    return out.filter(F.col("character").isNotNull())


def direct(events: DataFrame) -> DataFrame:
    """(story, event, character, t): who takes part in an event or is told in it. events: (story, event, t, participants, communicates)."""
    seen, told = _each(events, F.col("participants")), _each(events, F.col("communicates.recipients"))
    return seen.unionByName(told).distinct().select(*FACT, "t")


def contacts(events: DataFrame) -> DataFrame:
    """(story, character, t, recipient, next): the first telling after t, for all who learn something at t and each of their recipients."""
    told = _each(events.withColumn("_speaker", F.col("communicates.speaker")), F.col("communicates.recipients"))
    speakers = events.select("story", "event", F.col("communicates.speaker").alias("speaker")).filter("speaker IS NOT NULL")
    told = told.join(speakers, ["story", "event"]).filter("character <> speaker")
    told = told.select("story", F.col("speaker").alias("character"), F.col("character").alias("recipient"), F.col("t").alias("next"))
    by = Window.partitionBy("story", "character", "recipient").orderBy("next")
    told = told.withColumn("_after", F.coalesce(F.lag("next").over(by), F.lit(0)))
    learns = direct(events).select("story", "character", "t").distinct()
    return interval_join(learns, told, ["story", "character"], "t", "_after", "next").drop("_after")


def earliest(events: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(story, event, character, t, known_at): t the event's time, known_at the earliest time at which the character could know of it.

    events: (story, event, t, participants, communicates). keep, where it is given, stores a row for each event
    (`sources.io.keeper`), so that several readers don't read the stories again.
    """
    rows = events.filter("story IS NOT NULL AND event IS NOT NULL").select(
        "story", "event", F.col("t").cast("int").alias("t"), "participants", F.col("communicates.speaker").alias("speaker"), F.col("communicates.recipients").alias("recipients")
    )
    spread = rows.repartition("story").sortWithinPartitions("story", F.desc("t")).mapInArrow(_spread, "story string, event string, t int, character array<string>, known_at array<int>")
    if keep is not None:
        spread = keep(spread)
    return spread.select("story", "event", "t", F.explode(F.arrays_zip("character", "known_at")).alias("k")).select("story", "event", "k.character", "t", "k.known_at")


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stories from their last event to their first. reach[a][b]: when what a knows after the event at hand comes to b."""
    story, now, reach, told = None, None, {}, []
    for batch in batches:
        out = []
        for s, event, t, participants, speaker, recipients in _columns(batch):
            if (s, t) != (story, now):
                _arrive(reach, told, now)
                told = []
            if s != story:
                reach = {}
            story, now = s, t
            who = {c: t for c in (*(participants or ()), *(recipients or ())) if c is not None}
            for c in list(who):
                for other, at in reach.get(c, {}).items():
                    if at < who.get(other, at + 1):
                        who[other] = at
            if who:
                out.append((s, event, t, list(who), list(who.values())))
            if speaker is not None and recipients:
                told.append((speaker, [r for r in recipients if r is not None and r != speaker]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], ["story", "event", "t", "character", "known_at"])


def _arrive(reach: dict, told: list, t: int) -> None:
    """Changes reach by the tellings of one time, none of which passes on what another one told."""
    after = {}
    for speaker, recipients in told:
        row = after.setdefault(speaker, dict(reach.get(speaker, ())))
        for r in recipients:
            for other, at in reach.get(r, {}).items():
                if other != speaker and at < row.get(other, at + 1):
                    row[other] = at
        row.update(dict.fromkeys(recipients, t))
    reach.update(after)


_STORY = "story string, _k int, pos int, id string, type string, words array<string>, participants array<string>, speaker string, recipients array<string>, froms array<string>, types array<string>, tos array<string>"


def states(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(story, character, section, from, type, believed, since, actual, is_false): what `beliefs_at` gives for the sections' ends and
    all characters, with `claims` and `learned`, in one reading of each story.

    events: (story, event, pos, ord, participants, communicates, changes), changes an array of (from, type, to); entities: (story, id, type, label).
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    field = lambda f: F.transform("changes", lambda x: x[f])
    fields = [x.split()[0] for x in _STORY.split(", ")]

    def rows(df: DataFrame, k: int, *order: Column, **columns: Column) -> DataFrame:
        cast = [x.split(" ", 1) for x in _STORY.split(", ")]
        given = columns | {"story": F.col("story"), "_k": F.lit(k)}
        return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in cast], *[c.alias(n) for n, c in zip(("_ord", "_event"), order, strict=True)])

    e = events.filter("story IS NOT NULL AND event IS NOT NULL")
    kind = e.schema["ord"].dataType
    none = (F.lit(None).cast(kind), F.lit(None).cast("string"))
    named = rows(entities.filter("story IS NOT NULL"), 0, *none, id=F.col("id"), type=F.col("type"), words=split(F.col("label")))
    ever = e.select("story", F.explode("changes").alias("c")).select("story", "c.from", "c.type", "c.to").distinct()
    ever = rows(ever, 1, *none, froms=F.array("from"), types=F.array("type"), tos=F.array("to"))
    played = rows(
        e, 2, F.col("ord"), F.col("event"), pos=F.col("pos"), words=split(F.col("communicates.content")), participants=F.col("participants"), speaker=F.col("communicates.speaker"),
        recipients=F.col("communicates.recipients"), froms=field("from"), types=field("type"), tos=field("to"),
    )
    parts = named.unionByName(ever).unionByName(played).repartition("story").sortWithinPartitions("story", "_k", "pos", "_ord", "_event").select(*fields)
    lists = ("from", "type", "believed", "since", "actual")
    held = parts.mapInArrow(_play, "story string, character string, section int, " + ", ".join(f"`{n}` array<{'int' if n == 'since' else 'string'}>" for n in lists))
    out = held.select("story", "character", "section", F.explode(F.arrays_zip(*lists)).alias("x")).select("story", "character", "section", "x.*")
    return out.withColumn("is_false", ~F.col("believed").eqNullSafe(F.col("actual")))


def _put(held: tuple | None, fact: tuple, since: int) -> tuple:
    """held with one more fact. Of all that is heard of a state (newest, since, other, since) is kept: the newest fact (about, speaker, to) and,
    if it is a claim, the newest one that its speaker did not claim, which is all that its speaker can believe."""
    if held is None:
        return (fact, since, None, 0)
    new, at, other, other_at = held
    if fact[0] > new[0]:
        if fact[1] is None:
            return (fact, since, None, 0)
        return (fact, since, other, other_at) if fact[1] == new[1] else (fact, since, new, at)
    if fact[0] < new[0] and new[1] is not None and fact[1] != new[1] and (other is None or fact[0] > other[0]):
        return (new, at, fact, since)
    return held


class _Story:
    """A story as far as it has been read."""

    def __init__(self, story: str):
        self.story, self.t, self.pos = story, 0, None
        self.characters: list[str] = []
        self.names: dict[str, list[tuple[str, list[str]]]] = {}
        self.ever: dict[str, dict[str, set[str]]] = {}
        self.heard: dict[str, dict[tuple, tuple]] = {}
        self.actual: dict[tuple, str] = {}

    def claimed(self, words: list[str]) -> dict[tuple, str]:
        """What a telling says of states that the story has at some time, by (from, type)."""
        hits: dict[str, int] = {}
        for i, w in enumerate(words):
            for id_, label in self.names.get(w, ()):
                if words[i : i + len(label)] == label:
                    hits[id_] = i
        said = {}
        for a in hits:
            for type_, ends in self.ever.get(a, {}).items():
                if both := ([b for b in hits if b in ends] if len(hits) < len(ends) else [b for b in ends if b in hits]):
                    said[a, type_] = max(both, key=lambda b: (hits[b], b))
        return said

    def event(self, words, participants, speaker, recipients, changes) -> None:
        self.t += 1
        facts: dict[tuple, tuple] = {}
        for a, type_, b in changes:
            old = facts.get((a, type_))
            if old is None or (b is not None and (old[2] is None or b > old[2])):
                facts[a, type_] = (self.t, None, b)
        said = {k: (self.t, speaker, b) for k, b in self.claimed(words).items() if k not in facts} if words else {}
        told = {r for r in recipients or () if r is not None}
        passed = self.heard.get(speaker, {}) if speaker is not None else {}
        for r in told:
            if r == speaker or not passed:
                continue
            own = self.heard.setdefault(r, {})
            for k, (new, _, other, _) in passed.items():
                held = _put(own.get(k), new, self.t)
                own[k] = _put(held, other, self.t) if other is not None else held
        for who in told.union(p for p in participants or () if p is not None):
            own = self.heard.setdefault(who, {})
            for k, fact in (*facts.items(), *said.items()):
                own[k] = _put(own.get(k), fact, self.t)
        for k, fact in facts.items():
            if None not in k:
                self.actual[k] = fact[2]

    def rows(self) -> Iterator[tuple]:
        """What each character believes by now."""
        for who in self.characters:
            believed = []
            for k, (new, at, other, other_at) in self.heard.get(who, {}).items():
                if new[1] is None or new[1] != who:
                    believed.append((*k, new[2], at, self.actual.get(k)))
                elif other is not None:
                    believed.append((*k, other[2], other_at, self.actual.get(k)))
            if believed:
                yield (self.story, who, self.pos, *zip(*believed, strict=True))


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stories from their first event to their last; rows at the end of each section."""
    names = ("story", "character", "section", "from", "type", "believed", "since", "actual")
    kinds = (pa.string(), pa.string(), pa.int32(), *[pa.list_(pa.int32() if n == "since" else pa.string()) for n in names[3:]])
    arrow = lambda out: pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], list(names))
    at, out, size = None, [], 0

    def ended() -> None:
        nonlocal size
        for row in at.rows():
            out.append(row)
            size += len(row[3])

    for batch in batches:
        for story, k, pos, id_, type_, words, participants, speaker, recipients, froms, types, tos in _columns(batch):
            if at is None or story != at.story or (at.pos is not None and pos != at.pos):
                if at is not None and at.pos is not None:
                    ended()
                if at is None or story != at.story:
                    at = _Story(story)
                if size > 50_000:
                    yield arrow(out)
                    out, size = [], 0
            if k == 0:
                if type_ == "character" and id_ is not None:
                    at.characters.append(id_)
                if words and id_ is not None:
                    at.names.setdefault(words[0], []).append((id_, words))
            elif k == 1:
                at.ever.setdefault(froms[0], {}).setdefault(types[0], set()).add(tos[0])
            else:
                at.pos = pos
                at.event(words, participants, speaker, recipients, zip(froms or (), types or (), tos or (), strict=True))
    if at is not None and at.pos is not None:
        ended()
    if out:
        yield arrow(out)


def claims(events: DataFrame, labels: DataFrame, states: DataFrame) -> DataFrame:
    """(story, event, from, type, to): what the words of a telling say of a state, true or not. labels: (story, id, label); states: (story, from, type, to).

    A telling claims a state that its story has at some time if its content names both ends, as whole words in any case. Of several ends
    for one (from, type) the one named last counts. Labels are found by their first word, in an equi-join.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    ws = events.select("story", "event", split(F.col("communicates.content")).alias("_words"))
    ws = ws.select("story", "event", "_words", F.posexplode("_words").alias("_at", "_first"))
    names = labels.select("story", "id", split(F.col("label")).alias("_label")).withColumn("_first", F.get("_label", F.lit(0))).filter("_first IS NOT NULL")
    hits = ws.join(names, ["story", "_first"]).filter(F.slice("_words", F.col("_at") + 1, F.size("_label")) == F.col("_label"))
    hits = hits.groupBy("story", "event", "id").agg(F.max("_at").alias("_at"))
    froms = hits.select("story", "event", F.col("id").alias("from")).join(states.select("story", "from", "type", "to").distinct(), ["story", "from"])
    both = froms.join(hits.withColumnRenamed("id", "to"), ["story", "event", "to"])
    return both.groupBy("story", "event", "from", "type").agg(F.max_by("to", F.struct("_at", "to")).alias("to"))


def learned(known: DataFrame, changes: DataFrame, events: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """(story, character, from, type, to, about, event, known_at): what characters learn of states; about is the time that it is said of.

    changes: (story, from, type, to, event). Who knows the event of a change knows the change. A claim is believed by all who know its
    telling but its speaker, and is about the time of the telling; what the event itself changes in the world goes before what is said in it.
    """
    facts = changes.select("story", "event", "from", "type", "to")
    out = known.join(facts, ["story", "event"])
    if claimed is not None:
        speaker = events.select("story", "event", F.col("communicates.speaker").alias("_speaker"))
        said = claimed.join(facts, ["story", "event", "from", "type"], "left_anti").join(speaker, ["story", "event"])
        said = known.join(said, ["story", "event"]).filter(~F.col("character").eqNullSafe(F.col("_speaker"))).drop("_speaker")
        out = out.unionByName(said)
    return out.select("story", "character", "from", "type", "to", F.col("t").alias("about"), "event", "known_at")


def belief_windows(learned_: DataFrame) -> DataFrame:
    """(story, character, from, type, to, about, event, since, until): what a character believes, from since to before until (null: open).

    News replaces a belief only if it is about a later time: who hears late of an old change is not moved by it.
    """
    key = ["story", "character", "from", "type"]
    at_once = learned_.groupBy(*key, "known_at").agg(F.max_by(F.struct("to", "about", "event"), F.struct("about", "event", "to")).alias("_b"))
    by = Window.partitionBy(*key).orderBy("known_at")
    newest = F.max("_b.about").over(by.rowsBetween(Window.unboundedPreceding, -1))
    out = at_once.withColumn("_newest", newest).filter("_newest IS NULL OR _b.about > _newest")
    return out.select(*key, "_b.to", "_b.about", "_b.event", F.col("known_at").alias("since"), F.lead("known_at").over(by).alias("until"))


def truth_windows(changes: DataFrame, at: DataFrame) -> DataFrame:
    """(story, from, type, actual, start, end): what holds, in times. A later change by the same event wins by its `to`. changes: (story, from, type, to, event)."""
    key = ["story", "from", "type"]
    placed = changes.join(at.select("story", "event", "t"), ["story", "event"]).groupBy(*key, "t").agg(F.max("to").alias("actual"))
    return placed.select(*key, "actual", F.col("t").alias("start"), F.lead("t").over(Window.partitionBy(*key).orderBy("t")).alias("end"))


def beliefs_at(keys: DataFrame, beliefs: DataFrame, truth: DataFrame) -> DataFrame:
    """(story, character, section, from, type, believed, since, actual, is_false) for keys (story, character, section, cutoff), cutoff a time.

    A state that nobody ever set before the cutoff has no truth: actual is null and the belief, made by words alone, is false.
    """
    key = ["story", "from", "type"]
    held = interval_join(keys, beliefs.withColumnRenamed("to", "believed"), ["story", "character"], "cutoff", "since", "until")
    held = held.select("story", "character", "section", "cutoff", "from", "type", "believed", "since")
    points = held.select(*key, "cutoff").distinct()
    actual = interval_join(points, truth, key, "cutoff", "start", "end").select(*key, "cutoff", "actual")
    out = held.join(actual, [*key, "cutoff"], "left")
    return out.withColumn("is_false", ~F.col("believed").eqNullSafe(F.col("actual"))).drop("cutoff")


def section_keys(at: DataFrame, characters: DataFrame) -> DataFrame:
    """Keys for each character (story, character) at the end of each section of the story in which something happens."""
    ends = at.groupBy("story", "pos").agg(F.max("t").alias("cutoff")).withColumnRenamed("pos", "section")
    return characters.select("story", "character").join(ends, "story")
