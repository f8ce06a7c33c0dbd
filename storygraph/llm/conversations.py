"""Conversation structure repair: the cheapest edits that give a conversation the roles (system)? (user assistant)+, or no rows.

Rows of a conversation, in order, are the steps of a lattice; its other axis are the four states of the role pattern: nothing yet, after
the system row, after a user row, after an assistant row. Keeping, renaming or deleting a row takes a step, inserting a row only changes
the state. A bidirectional Dijkstra search runs a heap from the start and one from the ends; it stops when no unfinished pair of paths
can be as cheap as the best crossing, so that all crossings of equal cost are seen, and takes the least audit of these. On both sides a
path's label is its cost with its audit (forwards its beginning, backwards its end): two paths of equal cost between the same nodes are
never one the beginning of the other, so the least whole audit consists of least parts.

Equal rows of a turn are added up before anything is shuffled. The rest is ordered by a range partitioning of (conversation, turn, role,
text), so one conversation may lie in many tasks, and is cut there into pieces of at most PIECE rows. A conversation that is one piece is
solved at once. Of the others each piece gets its cheapest edits from each state to each, and FAN pieces after another are joined into
one by the same search, until one is left: no task ever holds the rows of a long conversation. Its repaired rows are hashed in one task,
as the hash of a whole text has to be, but piece by piece.

Defined cases: `damaged` takes a null as one space, in the text, the role and the key that is hashed, while a null turn stays null and
sorts first; rows of a turn are ordered by role and text; a null conversation is one of its own; rows that repeat are duplicates; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storygraph.llm.common import stored

FULL = r"[^\x20\x09-\x0D]"
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that each state may go on with, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ENDS = (START, ASSISTANT)
PIECE, FAN = 256, 64

Step = list[tuple[int, int, int, str]]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): each row damaged in the way that a hash of its conversation and turn picks."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), way.alias("way")).filter("way != 0")
    return out.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("way") == 3, 2).otherwise(1).alias("copies"))


def _joined_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b; nulls of the keys are equal."""
    b = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], how).drop(*[f"_of_{k}" for k in keys])


def faults(rows: DataFrame) -> DataFrame:
    """A row for each (conv_id, turn, role, text): its copies and the first one's fault, if it has any; the other copies are duplicates, or all are blank.

    A (role, text) is first seen at its conversation's least turn that has it. Both are found by sums in parts and a join on whole rows,
    so a text that a third of all rows repeat lands in no one task.
    """
    key = ["conv_id", "role", "text"]
    order = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    each = rows.groupBy(*key, "turn").agg(F.sum("copies").alias("copies"))
    first = each.groupBy(*key).agg(F.min(order)["turn"].alias("turn")).withColumn("_first", F.lit(True))
    both = _joined_on(each, first, [*key, "turn"], "left")
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(~F.col("text").rlike(FULL), "blank").when(F.col("_first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return both.select(*key, "turn", "copies", fault.alias("fault"))


def counts(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated). rows: faults()."""
    of = lambda kind: F.sum(F.when(F.col("fault") == kind, F.col("copies")).otherwise(0))
    more = F.sum(F.when(F.coalesce(F.col("fault"), F.lit("")).isin("blank", "duplicate"), 0).otherwise(F.col("copies") - 1))
    one = F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0))
    turns = rows.groupBy("conv_id", "turn").agg(of("blank").alias("b"), (of("duplicate") + more).alias("d"), one.alias("t"))
    some = F.count("turn")
    gaps = F.when(some == 0, 0).otherwise(F.max("turn") - F.min("turn") + 1 - some)
    return turns.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"))


# What follows runs inside tasks, on the rows of a piece.


def row_steps(role: str, fault: str | None, copies: int) -> list[Step]:
    """The steps of a row (from state, to state, cost, audit), and of its further copies, which are all deleted."""
    gone = fault in ("blank", "duplicate")
    lost = copies if gone else copies - 1
    steps: list[Step] = []
    if not gone:
        more = TRUNCATED if fault == "truncated" else 0
        step = []
        for q, (wanted, then) in NEXT.items():
            step.append((q, q, DELETE, "D"))
            step.append((q, then, RENAME + more, "R"))
            if role[:1] == wanted[0]:
                step.append((q, then, more, "K"))
        if role[:1] == "s":
            step.append((START, SYSTEM, more, "K"))
        steps.append(step)
    if lost:
        steps.append([(q, q, DELETE * lost, "D" * lost) for q in NEXT])
    return steps


def cheapest(steps: list[Step], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost, and of its audits the least one, of a path from `start` before the first step to one of `ends` after the last."""
    n = len(steps)
    ahead = [{q: [(i + 1, b, c, x) for a, b, c, x in s if a == q] for q in NEXT} for i, s in enumerate(steps)] + [{q: [] for q in NEXT}]
    back = [{q: [] for q in NEXT}] + [{q: [(i, a, c, x) for a, b, c, x in s if b == q] for q in NEXT} for i, s in enumerate(steps)]
    into = {q: [a for a, (_, b) in NEXT.items() if b == q] for q in NEXT}
    labels: tuple[dict, dict] = {(0, start): (0, "")}, {(n, q): (0, "") for q in ends}
    heaps = [(0, 0, "", start)], [(0, 0, "", q) for q in sorted(ends)]  # backwards, later rows are finished first
    done: tuple[set, set] = set(), set()
    best = (0, "") if n == 0 and start in ends else None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, audit, q = heapq.heappop(heaps[side])
        i = at if side == 0 else n - at
        if (i, q) in done[side]:
            continue
        done[side].add((i, q))
        if side == 0:
            near = [*ahead[i][q], (i, NEXT[q][1], INSERT, "I")]
        else:
            near = [*back[i][q], *((i, a, INSERT, "I") for a in into[q])]
        for j, r, c, x in near:
            label = (cost + c, audit + x if side == 0 else x + audit)
            if label < labels[side].get((j, r), (1 << 62, "")):
                labels[side][j, r] = label
                heapq.heappush(heaps[side], (label[0], j if side == 0 else n - j, label[1], r))
                other = labels[1 - side].get((j, r))
                if other is not None:
                    whole = (label[0] + other[0], label[1] + other[1] if side == 0 else other[1] + label[1])
                    best = whole if best is None or whole < best else best
    return best


def ways(steps: list[Step]) -> Step:
    """The cheapest edits from each state to each, as one step."""
    found = ((q, r, cheapest(steps, q, (r,))) for q in NEXT for r in NEXT)
    return [(q, r, *w) for q, r, w in found if w is not None]


def follows(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def repaired(rows: list[tuple[str, str, int]], audit: str, emitted: int, system: bool) -> Iterator[str]:
    """The lines of the repaired rows. rows: (role, text, copies); emitted: how many rows stand before them; system: whether the first is one."""
    whole = ((role, text) for role, text, copies in rows for _ in range(copies))
    for x in audit:
        role, text = ("", "") if x == "I" else next(whole)
        if x == "D":
            continue
        wanted = ("user", "assistant")[(emitted - system) % 2]
        yield f"{role if x == 'K' else wanted}:{text}"
        emitted += 1


def _digest(lines: Iterator[str], started: bool, sha) -> bool:
    for line in lines:
        sha.update((b"\n" if started else b"") + line.encode("utf-8", "surrogatepass"))
        started = True
    return started


PIECES = "conv_id {id}, whole boolean, part int, place long, illegal long, head string, tail string, cost long, audit string, sha string, n long, ways array<struct<q:int,r:int,cost:long,audit:string>>, rows array<struct<role:string,text:string,copies:int>>"


def _cut(kind: str, most: int):
    """Pieces of at most `most` of the sorted rows (part, conv_id, turn, role, text, copies, fault) of one task: solved ones of conversations that lie inside it, ways of others."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_parse_datatype_string(PIECES.format(id=kind)))

    def piece(conv, part: int, place: int, rows: list[tuple], whole: bool) -> dict:
        steps = [s for role, _, copies, fault in rows for s in row_steps(role, fault, copies)]
        illegal = sum(copies - 1 for _, _, copies, _ in rows) + sum(not follows(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))
        out = {"conv_id": conv, "whole": whole, "part": part, "place": place, "illegal": illegal, "head": rows[0][0], "tail": rows[-1][0], "n": sum(r[2] for r in rows)}
        if whole:
            cost, audit = cheapest(steps, START, ENDS)
            sha, kept = hashlib.sha256(), audit.replace("D", "")
            _digest(repaired([r[:3] for r in rows], audit, 0, len(kept) % 2 == 1), False, sha)
            return out | {"cost": cost, "audit": audit, "sha": sha.hexdigest()}
        return out | {"ways": [dict(zip(("q", "r", "cost", "audit"), w, strict=True)) for w in ways(steps)], "rows": [dict(zip(("role", "text", "copies"), r, strict=False)) for r in rows]}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, rows, place, part, first = None, [], 0, 0, True
        for batch in batches:
            for part, conv, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "role", "text", "copies", "fault")), strict=True):
                if rows and (conv != now or len(rows) >= most):
                    # What begins the task's rows, or goes on, may have rows elsewhere.
                    yield piece(now, part, place, rows, conv != now and place == 0 and not first)
                    first, place = first and conv == now, place + 1 if conv == now else 0
                    rows = []
                now = conv
                rows.append((role, text, copies, fault))
        if rows:
            yield piece(now, part, place, rows, False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for made in pieces(batches):
            held.append(made)
            if len(held) >= 1000 or not made["whole"]:
                yield from pa.Table.from_pylist(held, schema).to_batches()
                held = []
        if held:
            yield from pa.Table.from_pylist(held, schema).to_batches()

    return cut


def _joined(table: pa.Table) -> pa.Table:
    """One way table of up to FAN neighbouring pieces (conv_id, at, grp, ways), with the lengths of their audits along each way."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    steps, out = [[(w["q"], w["r"], w["cost"], w["audit"]) for w in r["ways"]] for r in rows], []
    for q, r, cost, audit in ways(steps):
        out.append({"q": q, "r": r, "cost": cost, "audit": audit})
    made = {"conv_id": [rows[0]["conv_id"]], "at": [rows[0]["grp"]], "ways": [out]}
    return pa.table(made, schema=table.select(["conv_id", "at", "ways"]).schema)


def _numbered(pieces: DataFrame, *order: str) -> DataFrame:
    """With at, the number of a piece in its conversation: a row for every PIECE rows, ids alone."""
    return pieces.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1)


def _long(pieces: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, sha) of conversations in several pieces. pieces: those of _cut, stored."""
    kind = dict(pieces.dtypes)["conv_id"]
    at = stored(_numbered(pieces.select("conv_id", "part", "place", "head", "tail", "illegal", "n"), "part", "place"), "conversation-pieces")
    by = Window.partitionBy("conv_id").orderBy("at")
    legal = F.concat(F.substring("tail", 1, 1), F.substring(F.lead("head").over(by), 1, 1)).isin("su", "ua", "au")
    illegal = at.select("conv_id", (F.col("illegal") + F.when(legal, 0).otherwise(F.when(F.lead("head").over(by).isNull(), 0).otherwise(1))).alias("illegal"))
    illegal = illegal.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    keys = ["conv_id", "part", "place"]
    level = _joined_on(pieces.select(*keys, "ways"), at.select(*keys, "at"), keys).select("conv_id", F.col("at").cast("long").alias("at"), "ways")
    most = (at.agg(F.max("at")).first()[0] or 0) + 1
    while True:
        grouped = level.withColumn("grp", F.floor(F.col("at") / FAN)).groupBy("conv_id", "grp")
        level = stored(grouped.applyInArrow(_joined, f"conv_id {kind}, at long, ways array<struct<q:int,r:int,cost:long,audit:string>>"), "conversation-ways")
        most = -(-most // FAN)
        if most <= 1:
            break
    chosen = level.select("conv_id", F.explode(F.filter("ways", lambda w: (w["q"] == START) & w["r"].isin(*ENDS))).alias("w")).groupBy("conv_id")
    chosen = stored(chosen.agg(F.min(F.struct("w.cost", "w.audit")).alias("m")).select("conv_id", "m.*"), "conversation-audits")
    # Each piece takes its rows' part of the audit: after as many edits of rows as stand before it.
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = at.select(*keys, "at", "n", before.alias("_before"), F.lead("at").over(by).isNull().alias("_last"))
    spans = _joined_on(spans, chosen.select("conv_id", "audit"), ["conv_id"]).mapInArrow(_spans, f"conv_id {kind}, part int, place long, at int, slice string, emitted long, system boolean")
    texts = _joined_on(pieces.select(*keys, "rows"), spans, keys)
    hashed = texts.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_hashed, f"conv_id {kind}, sha string")
    return _joined_on(_joined_on(chosen, illegal, ["conv_id"]), hashed, ["conv_id"]).select("conv_id", "illegal", "cost", "audit", "sha")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = {c: batch.column(c) for c in ("conv_id", "part", "place", "at")}
        slices, emitted, system = [], [], []
        for audit, n, before, last in zip(*(batch.column(c).to_pylist() for c in ("audit", "n", "_before", "_last")), strict=True):
            ends = [0, *(i + 1 for i, x in enumerate(audit) if x != "I")]
            a, b = ends[before], len(audit) if last else ends[before + n]
            slices.append(audit[a:b])
            emitted.append(a - audit.count("D", 0, a))
            system.append((len(audit) - audit.count("D")) % 2 == 1)
        yield pa.RecordBatch.from_pydict(made | {"slice": pa.array(slices, pa.string()), "emitted": pa.array(emitted, pa.int64()), "system": pa.array(system, pa.bool_())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's repaired rows, fed piece by piece."""
    now, sha, started, kind, none = None, None, False, None, True
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i in range(batch.num_rows):
            conv, at, audit, emitted, system, rows = (batch.column(c)[i].as_py() for c in ("conv_id", "at", "slice", "emitted", "system", "rows"))
            if not none and conv != now:
                yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([sha.hexdigest()])], ["conv_id", "sha"])
            if none or conv != now:
                now, sha, started, none = conv, hashlib.sha256(), False, False
            started = _digest(repaired([(r["role"], r["text"], r["copies"]) for r in rows], audit, emitted, system), started, sha)
    if not none:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([sha.hexdigest()])], ["conv_id", "sha"])


def solved(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, sha) of each conversation in rows. rows: faults(), stored."""
    kind = dict(rows.dtypes)["conv_id"]
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    pieces = dealt.select("part", "conv_id", "role", "text", F.col("copies").cast("int").alias("copies"), "fault").mapInArrow(_cut(kind, PIECE), PIECES.format(id=kind))
    pieces = stored(pieces, "conversation-pieces")
    return pieces.filter("whole").select("conv_id", "illegal", "cost", "audit", "sha").unionByName(_long(pieces.filter("NOT whole")))


def repair(rows: DataFrame) -> DataFrame:
    """What rows (conv_id, turn, role, text, copies) have wrong, and their repair: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    checked = stored(faults(rows), "conversation-faults")
    return _joined_on(counts(checked), solved(checked), ["conv_id"]).withColumnRenamed("sha", "repaired_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = _joined_on(rows.select("conv_id").distinct(), repair(damaged(rows)), ["conv_id"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _add(label: str, cost: str, x: str) -> str:
    """SQL: a label of eight digits of cost and an audit, longer by an edit; null stays null."""
    return f"(lpad((left({label}, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({label}, 9) || '{x}')"


_s2 = f"least(t2, {_add('t0', '2', 'I')}, {_add('t1', '2', 'I')}, {_add('t3', '2', 'I')})"
_inserted = f"t0 AS s0, t1 AS s1, {_s2} AS s2, least(t3, {_add(_s2, '2', 'I')}) AS s3"
_d = [_add(f"s{q}", "3", "D") for q in range(4)]
_r, _k = [_add(f"s{q}", "2 + m", "R") for q in range(4)], [_add(f"s{q}", "m", "K") for q in range(4)]
#: DuckDB, on whole tables: for each row in turn the least label of each state.
ORACLE = rf"""
WITH RECURSIVE b AS (SELECT list(v ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(b))),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]))) % 20 AS way FROM conversations, b),
d AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE way <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS c FROM o),
n AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) AS size FROM f GROUP BY 1),
j AS (SELECT conv_id, c || lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM f),
k AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY 1),
p AS (SELECT conv_id, 0::BIGINT AS i, {_inserted} FROM (SELECT conv_id, '00000000' AS t0, NULL::VARCHAR AS t1, NULL::VARCHAR AS t2, NULL::VARCHAR AS t3 FROM n)
 UNION ALL SELECT conv_id, i, {_inserted} FROM (SELECT f.conv_id, f.i,
  {_d[0]} AS t0,
  least({_d[1]}, CASE WHEN live AND c = 's' THEN {_k[0]} END) AS t1,
  least({_d[2]}, CASE WHEN live THEN least({_r[0]}, {_r[1]}, {_r[3]}) END, CASE WHEN live AND c = 'u' THEN least({_k[0]}, {_k[1]}, {_k[3]}) END) AS t2,
  least({_d[3]}, CASE WHEN live THEN {_r[2]} END, CASE WHEN live AND c = 'a' THEN {_k[2]} END) AS t3
  FROM p JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS live, (fault = 'truncated')::INT AS m FROM f) f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)),
q AS (SELECT p.conv_id, least(s0, s3) AS label, gaps, blank, duplicate, truncated FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = size),
l AS (SELECT conv_id, substr(label, 9) AS audit, unnest(string_split(substr(label, 9), '')) AS x, generate_subscripts(string_split(substr(label, 9), ''), 1) AS pos FROM q),
m AS (SELECT *, count(*) FILTER (x <> 'I') OVER w AS i, count(*) FILTER (x <> 'D') OVER w AS emitted, len(replace(audit, 'D', '')) % 2 AS first_system FROM l WHERE x <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
y AS (SELECT m.conv_id, pos, CASE x WHEN 'K' THEN role ELSE CASE (emitted - 1 - first_system) % 2 WHEN 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE x WHEN 'I' THEN '' ELSE text END AS line FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i AND x <> 'I' WHERE x <> 'D'),
z AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS sha FROM y GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(left(label, 8)::BIGINT, 0) AS cost, coalesce(substr(label, 9), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
