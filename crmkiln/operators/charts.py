"""The 21 chart datasets: ordered, scaled and rounded views of the aggregates.

A chart has one row per label, so most frames are as small as what a browser can draw; a chart whose labels
grow with the data is ``wide``, and its rows are ranked in many tasks. ``position`` carries the order, ties are
settled by the label.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln import labels
from crmkiln.functions.columns import hour_label, ordinal, round_exact
from crmkiln.functions.measures import named
from crmkiln.operators import ranking
from crmkiln.operators.aggregates import AGGREGATES, Aggregate


@dataclass(frozen=True)
class Series:
    """One list of numbers: a measure, whole (``digits`` None) or rounded, a rate in percent."""

    name: str
    measure: str
    digits: int | None = None
    percent: bool = False
    title: str | None = None

    def value(self, measured: str) -> str:
        if self.digits is None:
            return f"CAST({measured} AS BIGINT)"
        return round_exact(f"{measured} * 100" if self.percent else measured, self.digits)


@dataclass(frozen=True)
class Chart:
    """``order`` is None for label order, a measure name for descending order, or a label list.
    ``wide``: all of a label set without a bound are shown."""

    name: str
    aggregate: str
    series: tuple[Series, ...]
    order: str | tuple[str, ...] | None = None
    top: int | None = None
    wide: bool = False

    @property
    def spec(self) -> Aggregate:
        return AGGREGATES[self.aggregate]

    @property
    def label_name(self) -> str:
        return "hour" if self.spec.key == "send_hour" else self.spec.key

    @property
    def titled(self) -> bool:
        """Trend charts are served as titled datasets, the others as named lists."""
        return self.series[0].title is not None

    def sort_key(self, key: str, measure: Callable[[str], str]) -> str:
        """Ascending sort key; ``measure`` gives the expression of a measure of the aggregate."""
        if self.order is None:
            return key
        if isinstance(self.order, str):
            return f"-{measure(self.order)}"
        return ordinal(key, self.order)

    def label(self, key: str) -> str:
        return hour_label(key) if self.spec.key == "send_hour" else key


def _whole(name: str, measure: str | None = None, title: str | None = None) -> Series:
    return Series(name, measure or name, title=title)


def _number(name: str, measure: str, digits: int, title: str | None = None) -> Series:
    return Series(name, measure, digits, title=title)


def _percent(name: str, measure: str | None = None, digits: int = 1, title: str | None = None):
    return Series(name, measure or name, digits, percent=True, title=title)


_SALES = (_number("revenue", "total_revenue", 2), _percent("win_rate"), _whole("deal_count"))
_SCORED = (_whole("count"), _number("avg_score", "avg_lead_score", 1))
_TRAFFIC = (
    _whole("sessions"), _percent("bounce_rate"), _percent("conversion_rate", digits=2),
)
_FIRMS = (_whole("count", "company_count"), _number("avg_revenue", "avg_revenue", 2))

_CHARTS = [
    Chart("revenue_trend", "revenue_by_month", (
        _number("total_revenue", "total_revenue", 2, "Closed Revenue"),
        _number("weighted_pipeline", "weighted_pipeline", 2, "Weighted Pipeline"),
    )),
    Chart("deals_by_stage", "pipeline_stages",
          (_whole("counts", "count"), _number("values", "total_value", 2)),
          order=tuple(labels.DEAL_STAGES)),
    Chart("deals_by_region", "deals_by_region", _SALES, order="total_revenue"),
    Chart("deals_by_industry", "deals_by_industry", _SALES, order="total_revenue"),
    Chart("deals_by_pipeline", "deals_by_pipeline", _SALES),
    Chart("marketing_channels", "marketing_by_channel", (
        _whole("event_count"), _percent("engagement_rate"),
        _number("avg_duration", "avg_session_duration", 0),
    ), order="event_count"),
    Chart("marketing_trend", "marketing_by_month", (
        _whole("event_count", title="Events"), _percent("engagement_rate", title="Engagement %"),
    )),
    Chart("marketing_event_types", "marketing_by_event_type",
          (_whole("event_count"), _percent("engagement_rate")), order="event_count"),
    Chart("email_performance", "email_performance", (
        _percent("open_rate"), _percent("click_rate"), _percent("bounce_rate"),
        _percent("unsub_rate", digits=2),
    )),
    Chart("email_trend", "email_by_month", (
        _percent("open_rate", title="Open Rate %"), _percent("click_rate", title="Click Rate %"),
    )),
    Chart("email_by_hour", "email_by_hour", (_percent("open_rate"), _percent("click_rate"))),
    Chart("contacts_lifecycle", "contacts_by_lifecycle", _SCORED,
          order=tuple(labels.LIFECYCLE_STAGES)),
    Chart("contacts_by_source", "contacts_by_source", _SCORED, order="count"),
    Chart("support_by_category", "support_by_category", (
        _whole("ticket_count"), _number("avg_resolution", "avg_resolution_hours", 1),
        _percent("sla_compliance"), _number("satisfaction", "avg_satisfaction", 1),
    ), order="ticket_count"),
    Chart("support_by_priority", "support_by_priority", (
        _whole("ticket_count"), _number("avg_resolution", "avg_resolution_hours", 1),
        _percent("sla_compliance"),
    ), order=tuple(labels.TICKET_PRIORITIES)),
    Chart("web_top_pages", "web_by_page", _TRAFFIC, order="sessions", wide=True),
    Chart("web_by_country", "web_by_country",
          (_whole("sessions"), _percent("conversion_rate", digits=2)),
          order="sessions", top=labels.TOP_COUNTRIES),
    Chart("web_by_device", "web_by_device", _TRAFFIC),
    Chart("web_trend", "web_by_month", (
        _whole("sessions", title="Sessions"),
        _percent("conversion_rate", digits=2, title="Conversion %"),
    )),
    Chart("companies_by_industry", "companies_by_industry", _FIRMS, order="company_count"),
    Chart("companies_by_region", "companies_by_region", _FIRMS),
]
CHARTS = {chart.name: chart for chart in _CHARTS}


def _quoted(name: str) -> str:
    return f"`{name}`"


def _first_to_last(chart: Chart) -> list[str]:
    return [chart.sort_key(chart.spec.key, _quoted), chart.spec.key]


def shown(chart: Chart, aggregated: DataFrame) -> DataFrame:
    """The rows of the aggregate table that the chart shows: those with a label, and the first ones only
    where it has a limit."""
    labelled = aggregated.where(f"{chart.spec.key} IS NOT NULL")
    if chart.top is None:
        return labelled
    # Planned as TakeOrderedAndProject: each task keeps its own top rows only.
    return labelled.orderBy(*[F.expr(expression) for expression in _first_to_last(chart)]).limit(chart.top)


def chart_frame(chart: Chart, aggregated: DataFrame) -> DataFrame:
    """The chart as rows: position, label, series. ``aggregated`` is its aggregate table."""
    key = chart.spec.key
    rows = shown(chart, aggregated)
    position = f"CAST(row_number() OVER (ORDER BY {', '.join(_first_to_last(chart))}) AS BIGINT)"
    if chart.wide:
        read = {key, *[s.measure for s in chart.series]}
        rows = ranking.with_position(rows.select(*sorted(read)), _first_to_last(chart), "__position")
        position = "`__position`"
    return rows.selectExpr(*named({
        "position": position,
        chart.label_name: chart.label(key),
        **{s.name: s.value(_quoted(s.measure)) for s in chart.series},
    }))


# --- measures the dashboard derives from charts --------------------------------


def _share_of_largest(column: str) -> str:
    # One row per chart label: the window holds a chart, not a table.
    return f"`{column}` / max(`{column}`) OVER () * 100"


def funnel(chart_rows: DataFrame, column: str) -> DataFrame:
    """Funnel bar widths: share of the largest step in percent, with a visible minimum."""
    width = f"greatest({_share_of_largest(column)}, {labels.FUNNEL_MIN_WIDTH}D)"
    return chart_rows.selectExpr("*", f"{width} AS width")


def traffic_share(chart_rows: DataFrame) -> DataFrame:
    """Sessions of a page as a share of the busiest page in percent. Pages may be many: the largest number is
    one value, found by a partial aggregate, not a window over all pages."""
    busiest = chart_rows.agg(F.max("sessions")).scalar()
    return chart_rows.select("*", (F.col("sessions") / busiest * 100).alias("traffic_share"))


def top_industries(aggregated: DataFrame) -> DataFrame:
    """The ten industries with the most revenue, out of the deals-by-industry aggregate."""
    chart = replace(CHARTS["deals_by_industry"], top=labels.TOP_INDUSTRIES)
    return chart_frame(chart, aggregated).drop("deal_count")


def sla_bands(chart_rows: DataFrame) -> DataFrame:
    """Support categories with a verdict on their SLA compliance."""
    return chart_rows.selectExpr(
        "*",
        f"""CASE WHEN sla_compliance >= {labels.SLA_GOOD} THEN 'good'
            WHEN sla_compliance >= {labels.SLA_WARNING} THEN 'warning' ELSE 'bad' END AS sla_band""",
    )


def volume_in_thousands(chart_rows: DataFrame) -> DataFrame:
    """Marketing channels with their event count in thousands."""
    return chart_rows.selectExpr("*", "event_count / 1000 AS volume_k")
