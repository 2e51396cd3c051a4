"""The 22 grouped aggregates, declared once and run either one by one or one pass per entity.

``aggregate`` groups one entity by one key: scan -> partial aggregate -> exchange of one row per
key and task -> final aggregate. ``summarize`` computes every aggregate of an entity plus its
totals in a single pass over its unpivoted keys, so a full run scans each entity once instead of
once per aggregate. Its exchange carries the sum of the key cardinalities per task, not their product.
Hot keys are harmless in both: every measure combines before the exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from crmkiln import schemas
from crmkiln.functions.measures import Measure, all_inputs, count, mean, named, rows, total

ALL_ROWS = "all"


@dataclass(frozen=True)
class Aggregate:
    name: str
    source: str
    key: str
    measures: dict[str, Measure]

    @property
    def columns(self) -> set[str]:
        """Entity columns the aggregate reads."""
        return {self.key}.union(*[m.source_columns for m in self.measures.values()])

    @property
    def schema(self) -> StructType:
        key_type = LongType() if self.key == "send_hour" else StringType()
        return StructType([
            StructField(self.key, key_type),
            *[StructField(alias, LongType() if m.whole else DoubleType())
              for alias, m in self.measures.items()],
        ])

    @property
    def keyed(self) -> str:
        """Condition that a row has a key. A calendar label is missing exactly where its time is,
        and a condition on the time reaches the scan without computing the label."""
        time = f"`{schemas.TIME_COLUMN[self.source]}`"
        return f"{time if self.key in ('month', 'quarter') else self.key} IS NOT NULL"


# Decimals of the double columns: money has 2, velocity 4, probability and hours 1.
_AMOUNT, _REVENUE = ("amount", 2), ("annual_revenue", 2)
_WEIGHTED, _VELOCITY = ("weighted_amount", 2), ("velocity_score", 4)
_PROBABILITY, _HOURS = ("probability", 1), ("resolution_hours", 1)

_BY_PERIOD = {
    "total_revenue": total(*_AMOUNT),
    "weighted_pipeline": total(*_WEIGHTED),
    "avg_deal_size": mean(*_AMOUNT),
    "deal_count": count("deal_id"),
    "win_count": total("is_won"),
    "loss_count": total("is_lost"),
}
_DEALS = {
    "total_revenue": total(*_AMOUNT),
    "avg_deal_size": mean(*_AMOUNT),
    "deal_count": count("deal_id"),
    "win_rate": mean("is_won"),
}
_EVENTS = {
    "event_count": count("event_id"),
    "avg_session_duration": mean("session_duration_sec"),
    "engagement_rate": mean("is_engaged"),
}
_EMAILS = {
    "total_sent": count("email_event_id"),
    "open_rate": mean("is_opened"),
    "click_rate": mean("is_clicked"),
}
_BOUNCES = {"bounce_rate": mean("is_bounced")}
_CONTACTS = {
    "count": count("contact_id"),
    "avg_lead_score": mean("lead_score"),
    "avg_engagement": mean("engagement_index"),
}
_TICKETS = {
    "ticket_count": count("ticket_id"),
    "avg_resolution_hours": mean(*_HOURS),
    "sla_compliance": mean("sla_met"),
    "avg_satisfaction": mean("satisfaction_score"),
}
_SESSIONS = {
    "sessions": count("session_id"),
    "bounce_rate": mean("bounce"),
    "conversion_rate": mean("conversion"),
}
_DURATION = {"avg_duration": mean("session_duration_sec")}
_COMPANIES = {
    "company_count": count("company_id"),
    "avg_employees": mean("employee_count"),
    "avg_revenue": mean(*_REVENUE),
}

_DECLARED = [
    ("revenue_by_quarter", "deals", "quarter", _BY_PERIOD),
    ("revenue_by_month", "deals", "month", _BY_PERIOD),
    ("deals_by_region", "deals", "region", _DEALS | {"avg_velocity": mean(*_VELOCITY)}),
    ("deals_by_industry", "deals", "industry", _DEALS),
    ("pipeline_stages", "deals", "stage", {
        "count": count("deal_id"),
        "total_value": total(*_AMOUNT),
        "avg_probability": mean(*_PROBABILITY),
        "avg_days": mean("days_in_pipeline"),
    }),
    ("deals_by_pipeline", "deals", "pipeline", _DEALS),
    ("marketing_by_channel", "marketing_events", "channel",
     _EVENTS | {"avg_page_depth": mean("page_depth")}),
    ("marketing_by_month", "marketing_events", "month", _EVENTS),
    ("marketing_by_event_type", "marketing_events", "event_type", _EVENTS),
    ("email_performance", "email_campaigns", "campaign_type",
     _EMAILS | _BOUNCES | {"unsub_rate": mean("is_unsub")}),
    ("email_by_month", "email_campaigns", "month", _EMAILS | _BOUNCES),
    ("email_by_hour", "email_campaigns", "send_hour", _EMAILS),
    ("contacts_by_lifecycle", "contacts", "lifecycle_stage", _CONTACTS),
    ("contacts_by_source", "contacts", "lead_source", _CONTACTS),
    ("support_by_category", "support_tickets", "category", _TICKETS),
    ("support_by_priority", "support_tickets", "priority", _TICKETS),
    ("web_by_page", "web_analytics", "page_url",
     _SESSIONS | _DURATION | {"avg_page_views": mean("page_views")}),
    ("web_by_country", "web_analytics", "country", _SESSIONS | _DURATION),
    ("web_by_device", "web_analytics", "device_type", _SESSIONS | _DURATION),
    ("web_by_month", "web_analytics", "month",
     _SESSIONS | {"engagement_rate": mean("engaged_session")}),
    ("companies_by_industry", "companies", "industry",
     _COMPANIES | {"avg_traffic": mean("website_traffic_monthly")}),
    ("companies_by_region", "companies", "region", _COMPANIES),
]
AGGREGATES = {row[0]: Aggregate(*row) for row in _DECLARED}


def of_source(source: str) -> list[Aggregate]:
    return [spec for spec in AGGREGATES.values() if spec.source == source]


def aggregate(spec: Aggregate, processed: DataFrame) -> DataFrame:
    """One aggregate from its processed entity; rows without a key belong to no group."""
    measures = named({alias: m.combine() for alias, m in spec.measures.items()})
    return (
        processed.where(spec.keyed)
        .selectExpr(spec.key, *all_inputs(spec.measures.values()))
        .groupBy(spec.key)
        .agg(*[F.expr(item) for item in measures])
    )


# Totals per entity that the KPI row needs besides the measures of the aggregates.
TOTALS: dict[str, list[Measure]] = {
    "deals": [
        rows(), total(*_AMOUNT), total(*_AMOUNT, only="is_won"), total(*_WEIGHTED),
        mean("is_won"), mean(*_AMOUNT),
    ],
    "contacts": [rows()],
    "companies": [rows()],
    "web_analytics": [rows(), mean("conversion"), mean("bounce")],
    "support_tickets": [rows(), mean("satisfaction_score"), mean("sla_met")],
    "email_campaigns": [rows(), mean("is_opened"), mean("is_clicked")],
    "marketing_events": [rows()],
}


def _summary_measures(source: str) -> dict[str, Measure]:
    wanted = [m for spec in of_source(source) for m in spec.measures.values()]
    return {m.name: m for m in [*wanted, *TOTALS[source]]}


def summary_columns(source: str) -> set[str]:
    """Entity columns that the summary of an entity reads."""
    read = {spec.key for spec in of_source(source)}
    return read.union(*[m.source_columns for m in _summary_measures(source).values()])


def summarize(source: str, processed: DataFrame) -> DataFrame:
    """Every aggregate of an entity in one pass: one row per ``grouping`` (the name of a key column)
    and ``key`` (its value as text), and one row of grouping ``all`` for the whole table."""
    keys = {spec.key: f"CAST({spec.key} AS STRING)" for spec in of_source(source)}
    keys[ALL_ROWS] = "''"
    measures = _summary_measures(source)
    inputs = processed.selectExpr(*named(keys), *all_inputs(measures.values()))
    values = [name for name in inputs.columns if name not in keys]
    return (
        inputs.unpivot(values, list(keys), "grouping", "key")
        .where("key IS NOT NULL")
        .groupBy("grouping", "key")
        .agg(*[F.expr(item) for item in named({n: m.combine() for n, m in measures.items()})])
    )


def belongs(spec: Aggregate) -> str:
    """Condition on summary rows: the row is one group of this aggregate."""
    return f"`grouping` = '{spec.key}'"


def key_of(spec: Aggregate) -> str:
    """The key of a summary row in its own type."""
    return f"try_cast(key AS {spec.schema[spec.key].dataType.simpleString()})"


def from_summary(spec: Aggregate, summary: DataFrame) -> DataFrame:
    """One aggregate out of the summary of its entity."""
    return summary.where(belongs(spec)).selectExpr(
        f"{key_of(spec)} AS {spec.key}",
        *[f"{m.name} AS `{alias}`" for alias, m in spec.measures.items()],
    )
