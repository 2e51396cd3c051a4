"""Row-wise feature columns per entity. Narrow projections: no shuffle, all input columns kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crmkiln import labels
from crmkiln.functions.columns import (
    at_least, at_most, cut, flag, month_label, quarter_label, round_scaled, text, weekday_label,
)
from crmkiln.functions.measures import named

_VISIT_TIME = {
    "hour": "hour(`timestamp`)",
    "day_of_week": weekday_label("`timestamp`"),
    "month": month_label("`timestamp`"),
}
_ENGAGEMENT = f"(num_page_views + num_form_submissions * {labels.FORM_SUBMISSION_WEIGHT})"
_SLA_LIMIT = "CASE priority {} END".format(
    " ".join(f"WHEN {text(priority)} THEN {hours}" for priority, hours in labels.SLA_HOURS.items())
)

FEATURES: dict[str, dict[str, str]] = {
    "companies": {
        "employee_tier": cut("employee_count", labels.EMPLOYEE_EDGES, labels.EMPLOYEE_LABELS),
        "revenue_per_employee": round_scaled(
            f"annual_revenue / {at_least('employee_count', 1)}", 2),
        "company_age": f"{labels.REFERENCE_YEAR} - founded_year",
    },
    "contacts": {
        "lead_grade": cut("lead_score", labels.GRADE_EDGES, labels.GRADE_LABELS),
        "engagement_index": at_most(_ENGAGEMENT, labels.ENGAGEMENT_CAP),
    },
    "deals": {
        "revenue_bucket": cut("amount", labels.REVENUE_EDGES, labels.REVENUE_LABELS),
        "weighted_amount": round_scaled("amount * probability / 100", 2),
        "velocity_score": round_scaled(f"probability / {at_least('days_in_pipeline', 1)}", 4),
        "is_won": flag("stage = 'Closed Won'"),
        "is_lost": flag("stage = 'Closed Lost'"),
        "quarter": quarter_label("created_at"),
        "month": month_label("created_at"),
    },
    "marketing_events": {
        **_VISIT_TIME,
        "is_engaged": flag(f"session_duration_sec > {labels.ENGAGED_EVENT_SECONDS}"),
    },
    "email_campaigns": {
        "is_opened": flag("action IN ('Opened', 'Clicked')"),
        "is_clicked": flag("action = 'Clicked'"),
        "is_bounced": flag("action = 'Bounced'"),
        "is_unsub": flag("action IN ('Unsubscribed', 'Spam')"),
        "month": month_label("`timestamp`"),
    },
    "support_tickets": {
        "sla_met": flag(f"resolution_hours <= {_SLA_LIMIT}"),
        "quarter": quarter_label("created_at"),
    },
    "web_analytics": {
        **_VISIT_TIME,
        "engaged_session": flag(
            f"session_duration_sec > {labels.ENGAGED_SESSION_SECONDS} AND bounce = 0"),
    },
}


def process(name: str, df: DataFrame) -> DataFrame:
    """An entity with its feature columns; columns of the same name are replaced."""
    added = FEATURES[name]
    kept = [f"`{column}`" for column in df.columns if column not in added]
    return df.selectExpr(*kept, *named(added))
