import pytest
from compare import same

from civicledger.registry_of_queries import SPEND_ORACLES, SPEND_QUERIES
from civicledger.registry_of_runs import RUN_ORACLES, RUN_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SPEND_ORACLES | RUN_ORACLES))
def test_oracle(spark, name):
    same(spark, SF, (SPEND_QUERIES | RUN_QUERIES)[name], (SPEND_ORACLES | RUN_ORACLES)[name])


def test_entry_has_all_queries(spark):
    import __spark_entry__ as e

    assert set(SPEND_QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_page_links_of_navigation(spark):
    found = SPEND_QUERIES["page_links"](spark, SF)
    assert found.count() > 0 and found.filter("target NOT LIKE 'http%'").count() == 0


def test_plans(spark):
    from civicledger.plans import queries as q
    from civicledger.sources.catalog import load

    t = load(spark, SF)
    plan = q.transactions_page(t, 6)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in q.by_directorate(t)._jdf.queryExecution().toString()


def test_totals_agree(spark):
    from civicledger.plans import queries as q
    from civicledger.sources.catalog import load

    t = load(spark, SF)
    total = lambda df: round(sum(r["total"] for r in df.collect()), 2)
    assert total(q.by_category(t)) == total(q.monthly_trend(t)) == total(q.overview_spend(t))
