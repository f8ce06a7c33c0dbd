"""Queries over knowledge through chains of telling and over beliefs, and their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from storygraph.operators import belief as B
from storygraph.plans.sql import MOVES, with_
from storygraph.sources.projections import moves, told_moves


def earliest(spark, d):
    """Q8, Q9: when each character could first know of each event, by presence or through chains of telling."""
    in_order = Window.partitionBy("story").orderBy("pos", "ord", "event")
    return B.earliest(told_moves(spark, d).drop("changes").withColumn("t", F.row_number().over(in_order)))


def beliefs(spark, d):
    """What each character believes at the end of each section, and whether it holds there."""
    return B.states(told_moves(spark, d), moves(spark, d)["entities"])


QUERIES = {"belief_earliest": earliest, "belief_states": beliefs}

_KNOWN = with_(MOVES).replace("WITH ", "WITH RECURSIVE ", 1) + """,
b_ev AS (SELECT m.*, row_number() OVER (PARTITION BY m.story ORDER BY m.section_idx, m.ts, m.event_id)::INT AS t, e.user_id AS u,
  json_extract_string(e.props, '$.k')::INT AS k FROM m_all m JOIN events e ON e.event_id = m.event_id),
b_tell AS (SELECT story, event, t, "from" AS speaker, 'user_' || (u - u % 10 + (u % 10 + 1 + k % 3) % 10) AS recipient FROM b_ev WHERE event_type IN ('click', 'view')),
b_direct AS (SELECT story, event, "from" AS who, t FROM b_ev UNION SELECT story, event, recipient, t FROM b_tell),
b_next AS (SELECT d.story, d.who, d.t, l.recipient, min(l.t) AS next FROM (SELECT DISTINCT story, who, t FROM b_direct) d
  JOIN b_tell l ON l.story = d.story AND l.speaker = d.who AND l.t > d.t GROUP BY ALL),
b_reach AS (SELECT story, event, who, t AS got FROM b_direct
  UNION SELECT r.story, r.event, n.recipient, n.next FROM b_reach r JOIN b_next n ON n.story = r.story AND n.who = r.who AND n.t = r.got),
b_known AS (SELECT story, event, who, min(got)::INT AS known_at FROM b_reach GROUP BY ALL)
"""
ORACLES = {
    "belief_earliest": _KNOWN + "SELECT story, event, k.who AS character, e.t, k.known_at FROM b_known k JOIN b_ev e USING (story, event)",
    "belief_states": _KNOWN
    + """, b_said AS (SELECT story, event, "from", 'OWNS' AS type, 'item_' || k AS "to", t FROM b_ev e WHERE event_type = 'click'
  AND EXISTS (SELECT 1 FROM b_ev p WHERE p.story = e.story AND p."from" = e."from" AND p.type = 'OWNS' AND p."to" = 'item_' || e.k)),
b_learned AS (SELECT story, k.who, "from", type, "to", t AS about, k.known_at FROM b_known k JOIN b_ev USING (story, event)
  UNION ALL SELECT story, k.who, "from", type, "to", t, k.known_at FROM b_known k JOIN b_said s USING (story, event) WHERE k.who <> s."from"),
b_ends AS (SELECT story, section_idx AS section, max(t) AS cutoff FROM b_ev GROUP BY ALL),
b_held AS (SELECT story, l.who, e.section, e.cutoff, l."from", l.type, arg_max(l."to", about) AS believed, arg_max(l.known_at, about) AS since
  FROM b_learned l JOIN b_ends e USING (story) WHERE l.known_at <= e.cutoff AND (story, l.who) IN (SELECT (story, "from") FROM m_all) GROUP BY ALL),
b_truth AS (SELECT story, e.section, v."from", v.type, arg_max(v."to", v.t) AS actual FROM b_ev v JOIN b_ends e USING (story) WHERE v.t <= e.cutoff GROUP BY ALL)
SELECT story, who AS character, section, "from", type, believed, since, actual, believed IS DISTINCT FROM actual AS is_false
FROM b_held LEFT JOIN b_truth USING (story, section, "from", type)""",
}
