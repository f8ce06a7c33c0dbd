"""All queries of the library and their SQL, by name."""

from storygraph.plans import analytics_plans, belief_plans, graph_plans, index_plans, source_plans, story_plans, text_plans, timeline_plans

_PLANS = (graph_plans, analytics_plans, text_plans, timeline_plans, source_plans, story_plans, belief_plans, index_plans)
QUERIES = {n: f for p in _PLANS for n, f in p.QUERIES.items()}
ORACLES = {n: s for p in _PLANS for n, s in p.ORACLES.items()}
