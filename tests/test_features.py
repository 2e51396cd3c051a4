"""Feature columns per entity."""

import pytest

from crmkiln import schemas
from crmkiln.operators import features
from fixtures import NOON, column, deal, entity, session, ticket


def process(spark, name, rows):
    return features.process(name, entity(spark, name, rows))


@pytest.mark.parametrize("name", schemas.ENTITIES)
def test_input_columns_are_kept_and_features_added(spark, name):
    raw = entity(spark, name, [])
    done = features.process(name, raw)
    assert done.columns == raw.columns + list(features.FEATURES[name])
    again = features.process(name, done)
    assert sorted(again.columns) == sorted(done.columns)


def test_companies(spark):
    done = process(spark, "companies", [
        {"company_id": 1, "employee_count": 0, "annual_revenue": 100.0, "founded_year": 1950},
        {"company_id": 2, "employee_count": 3, "annual_revenue": 100.0, "founded_year": 2025},
        {"company_id": 3, "annual_revenue": 100.0},
    ])
    assert column(done, "revenue_per_employee", "company_id") == [100.0, 33.33, None]
    assert column(done, "employee_tier", "company_id") == [None, "Micro", None]
    assert column(done, "company_age", "company_id") == [75, 0, None]


def test_contacts(spark):
    done = process(spark, "contacts", [
        {"contact_id": 1, "num_page_views": 500, "num_form_submissions": 10, "lead_score": 0},
        {"contact_id": 2, "num_page_views": 990, "num_form_submissions": 2, "lead_score": 101},
        {"contact_id": 3, "num_form_submissions": 2},
    ])
    assert column(done, "engagement_index", "contact_id") == [600, 1000, None]
    assert column(done, "lead_grade", "contact_id") == ["F", None, None]


def test_deals(spark):
    done = process(spark, "deals", [
        deal(1, stage="Closed Won", amount=1234.56, probability=12.5),
        deal(2, stage="Closed Lost", days_in_pipeline=0, probability=33.3),
        deal(3, stage=None, amount=None, days_in_pipeline=None, created_at=None),
        deal(4, days_in_pipeline=7, probability=10.0),
    ])
    assert column(done, "weighted_amount", "deal_id") == [154.32, 33.3, None, 10.0]
    assert column(done, "velocity_score", "deal_id") == [1.25, 33.3, None, 1.4286]
    assert column(done, "is_won", "deal_id") == [1, 0, 0, 0]
    assert column(done, "is_lost", "deal_id") == [0, 1, 0, 0]
    assert column(done, "quarter", "deal_id") == ["2023Q2", "2023Q2", None, "2023Q2"]
    assert column(done, "month", "deal_id") == ["2023-04", "2023-04", None, "2023-04"]


def test_marketing_events(spark):
    done = process(spark, "marketing_events", [
        {"event_id": 1, "session_duration_sec": 60, "timestamp": NOON},
        {"event_id": 2, "session_duration_sec": 61, "timestamp": NOON},
        {"event_id": 3},
    ])
    assert column(done, "is_engaged", "event_id") == [0, 1, 0]
    assert column(done, "hour", "event_id") == [13, 13, None]
    assert column(done, "day_of_week", "event_id") == ["Saturday", "Saturday", None]


def test_email_campaigns(spark):
    actions = ["Sent", "Delivered", "Opened", "Clicked", "Bounced", "Unsubscribed", "Spam", None]
    done = process(spark, "email_campaigns", [
        {"email_event_id": i, "action": action} for i, action in enumerate(actions)
    ])
    flags = ["is_opened", "is_clicked", "is_bounced", "is_unsub"]
    assert [column(done, name, "email_event_id") for name in flags] == [
        [0, 0, 1, 1, 0, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0, 0],
        [0, 0, 0, 0, 1, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1, 0],
    ]


def test_sla(spark):
    cases = [
        ("Critical", 4.0, 1), ("Critical", 4.1, 0), ("High", 24.0, 1), ("High", 24.1, 0),
        ("Medium", 72.0, 1), ("Medium", 72.1, 0), ("Low", 168.0, 1), ("Low", 168.1, 0),
        ("Unspecified", 1.0, 0), (None, 1.0, 0), ("Low", None, 0),
    ]
    done = process(spark, "support_tickets", [
        ticket(i, priority=priority, resolution_hours=hours)
        for i, (priority, hours, _) in enumerate(cases)
    ])
    assert column(done, "sla_met", "ticket_id") == [expected for _, _, expected in cases]


def test_web_analytics(spark):
    done = process(spark, "web_analytics", [
        session(1, session_duration_sec=30), session(2, session_duration_sec=31),
        session(3, session_duration_sec=31, bounce=1), session(4, bounce=None),
    ])
    assert column(done, "engaged_session", "session_id") == [0, 1, 0, 0]


def test_features_do_not_depend_on_the_session_zone(spark):
    def run():
        done = process(spark, "web_analytics", [session(1)])
        return done.select("hour", "day_of_week", "month").first()

    expected = run()
    try:
        for zone in ("America/Sao_Paulo", "Asia/Kolkata", "Pacific/Apia"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert run() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
