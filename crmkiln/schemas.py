"""Schemas of the seven raw entity tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

_TYPES = {"L": LongType(), "D": DoubleType(), "S": StringType(), "T": TimestampNTZType()}


def _schema(columns: str) -> StructType:
    """``"deal_id L, amount D"`` -> StructType; L long, D double, S string, T time without zone."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in pairs])


RAW = {
    "companies": _schema(
        "company_id L, company_name S, industry S, region S, employee_count L, annual_revenue D,"
        "founded_year L, website_traffic_monthly L, created_at T"
    ),
    "contacts": _schema(
        "contact_id L, email S, company_id L, job_title S, lead_source S, lead_score L,"
        "lifecycle_stage S, region S, first_touch_date T, num_page_views L, num_form_submissions L"
    ),
    "deals": _schema(
        "deal_id L, contact_id L, company_id L, deal_name S, amount D, stage S, pipeline S,"
        "probability D, days_in_pipeline L, created_at T, industry S, region S"
    ),
    "marketing_events": _schema(
        "event_id L, contact_id L, event_type S, channel S, campaign_id L, utm_source S,"
        "device_type S, session_duration_sec L, page_depth L, timestamp T"
    ),
    "email_campaigns": _schema(
        "email_event_id L, contact_id L, campaign_id L, campaign_type S, action S,"
        "subject_line_length L, send_hour L, send_day_of_week L, timestamp T"
    ),
    "support_tickets": _schema(
        "ticket_id L, contact_id L, company_id L, category S, priority S, status S,"
        "resolution_hours D, satisfaction_score L, num_interactions L, created_at T"
    ),
    "web_analytics": _schema(
        "session_id L, page_url S, referrer_domain S, browser S, device_type S, country S,"
        "session_duration_sec L, page_views L, bounce L, conversion L, timestamp T"
    ),
}
ENTITIES = list(RAW)

#: The column that says when a row of an entity came about.
TIME_COLUMN = {
    "companies": "created_at",
    "contacts": "first_touch_date",
    "deals": "created_at",
    "marketing_events": "timestamp",
    "email_campaigns": "timestamp",
    "support_tickets": "created_at",
    "web_analytics": "timestamp",
}
