"""Grouped aggregates, one by one and in one pass."""

import pytest

from compare import spark_table
from crmkiln import schemas
from crmkiln.operators import aggregates, features, kpis, quality
from crmkiln.operators.aggregates import AGGREGATES
from crmkiln.plans.queries import processed
from fixtures import deal, entity, session


def deals(spark, rows):
    return features.process("deals", entity(spark, "deals", rows))


def test_rows_without_a_key_form_no_group(spark):
    df = deals(spark, [deal(1), deal(2, region=None, created_at=None)])
    for name in ("deals_by_region", "revenue_by_month", "revenue_by_quarter"):
        got = aggregates.aggregate(AGGREGATES[name], df).collect()
        assert [row.deal_count for row in got] == [1]
    summary = aggregates.summarize("deals", df)
    for name in ("deals_by_region", "revenue_by_month", "revenue_by_quarter"):
        assert aggregates.from_summary(AGGREGATES[name], summary).count() == 1
    stages = aggregates.aggregate(AGGREGATES["pipeline_stages"], df).collect()
    assert [row["count"] for row in stages] == [2]


def test_rows_without_an_id_are_summed_but_not_counted(spark):
    df = deals(spark, [deal(1), deal(None, amount=0.5)])
    row = aggregates.aggregate(AGGREGATES["deals_by_region"], df).first()
    assert (row.deal_count, row.total_revenue, row.avg_deal_size) == (1, 100.5, 50.25)


def test_group_without_values(spark):
    df = deals(spark, [deal(1, amount=None)])
    row = aggregates.aggregate(AGGREGATES["deals_by_region"], df).first()
    assert (row.total_revenue, row.avg_deal_size, row.win_rate) == (0.0, None, 0.0)


def test_open_deals_count_in_the_win_rate(spark):
    df = deals(spark, [deal(1, stage="Closed Won"), deal(2), deal(3), deal(4, stage="Closed Lost")])
    row = aggregates.aggregate(AGGREGATES["revenue_by_quarter"], df).first()
    assert (row.win_count, row.loss_count, row.deal_count, row.total_revenue) == (1, 1, 4, 400.0)
    assert aggregates.aggregate(AGGREGATES["deals_by_region"], df).first().win_rate == 0.25


def test_every_aggregate_is_declared():
    assert len(AGGREGATES) == 22
    assert {spec.source for spec in AGGREGATES.values()} == set(schemas.ENTITIES)


@pytest.mark.parametrize("source", schemas.ENTITIES)
def test_one_pass_gives_the_same_tables(spark, sf_dir, source):
    df = processed(spark, sf_dir, source)
    summary = aggregates.summarize(source, df)
    for spec in aggregates.of_source(source):
        alone = spark_table(aggregates.aggregate(spec, df))
        assert spark_table(aggregates.from_summary(spec, summary)) == alone
        assert len(alone[1]) > 0


@pytest.mark.parametrize("source", schemas.ENTITIES)
def test_results_do_not_depend_on_partitioning(spark, sf_dir, source):
    df = processed(spark, sf_dir, source)
    expected = spark_table(aggregates.summarize(source, df))
    for partitions in (3, 11):
        assert spark_table(aggregates.summarize(source, df.repartition(partitions))) == expected


def test_kpis_of_hand_made_rows(spark):
    tables = {
        "deals": deals(spark, [deal(1, stage="Closed Won"), deal(2, amount=50.25), deal(None)]),
        "web_analytics": features.process("web_analytics", entity(spark, "web_analytics", [
            session(1, conversion=1), session(2, bounce=1), session(3),
        ])),
    }
    row = kpis.kpi_row(spark, tables).first()
    assert row.total_revenue == 250.25
    assert row.won_revenue == 100.0
    assert row.pipeline_value == 125.12
    assert row.win_rate == 33.3
    assert row.avg_deal_size == 83.42
    assert row.total_deals == 3
    assert (row.conversion_rate, row.bounce_rate, row.total_sessions) == (33.33, 33.3, 3)
    # absent tables
    assert (row.total_contacts, row.total_tickets, row.avg_csat, row.email_open_rate) == (0, 0, 0, 0)
    assert kpis.records_loaded(kpis.kpi_row(spark, tables)).first().records_loaded == 6


def test_kpis_of_empty_and_absent_tables(spark):
    row = kpis.kpi_row(spark, {"deals": deals(spark, [])}).first()
    assert (row.total_revenue, row.won_revenue, row.total_deals) == (0.0, 0.0, 0)
    assert row.win_rate is None and row.avg_deal_size is None
    nothing = kpis.kpi_row(spark, {}).first()
    assert set(nothing) == {0} and len(nothing) == 16


def _checked(spark, rows):
    df = deals(spark, rows)
    filled = quality.filled_summaries({"deals": aggregates.summarize("deals", df)})
    found = {row.check: row.violations for row in quality.check(spark, {"deals": df}, filled).collect()}
    assert found == {row.check: row.violations for row in quality.check_rows(spark, {"deals": df}).collect()}
    return found


def test_quality_finds_violations(spark):
    found = _checked(spark, [deal(None), deal(2, amount=-5.0), deal(3, amount=None)])
    assert found["deals.deal_id is present"] == 1
    assert found["deals.weighted_amount is not negative"] == 2
    assert found["deals.is_won is 0 or 1"] == 0
    assert found["deals_by_region is not empty"] == 0
    # Entities that are absent violate all of their checks.
    assert found["companies.company_id is present"] == 1
    assert found["web_by_page is not empty"] == 1
    empty = _checked(spark, [])
    assert {number for check, number in empty.items() if "empty" in check} == {1}


def test_quality_without_any_table(spark):
    found = quality.check(spark, {}, []).collect()
    assert len(found) > 22 and {row.violations for row in found} == {1}
