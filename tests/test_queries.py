import pytest

from storygraph.plans import registry
from storygraph.sources.projections import conversations
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, data, name):
    same(spark, data, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_whole_queries_leave_nothing_out(spark, data):
    """All stories are listed, all their entities have a dossier and a position, and a dossier has every facet."""
    q = lambda n: registry.QUERIES[n](spark, data)
    stories = conversations(spark, data)["stories"].count()
    assert q("perspective_listed_stories").count() == stories
    assert q("timeline_entity_positions").select("story").distinct().count() == stories
    assert q("analytics_of_section").select("section").distinct().count() > 20 and q("reconcile_merge_clusters").select("cluster").distinct().count() > 99
    assert q("perspective_dossier").select("entity").distinct().count() > 3
    facets = {r["facet"] for r in q("perspective_whole_dossier").select("facet").distinct().collect()}
    assert facets == {"event", "state from", "state to", "mention", "clue case", "clue object", "clue discovered_by", "member character", "member organisation"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
