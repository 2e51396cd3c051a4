"""The KPI row: sixteen totals over six entities."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from crmkiln.functions.columns import round_exact
from crmkiln.functions.measures import Measure, all_inputs, mean, named, rows, total
from crmkiln.operators.aggregates import ALL_ROWS


@dataclass(frozen=True)
class Kpi:
    name: str
    source: str
    measure: Measure
    percent: bool = False
    digits: int | None = None


KPIS = [
    Kpi("total_revenue", "deals", total("amount", 2), digits=2),
    Kpi("won_revenue", "deals", total("amount", 2, only="is_won"), digits=2),
    Kpi("pipeline_value", "deals", total("weighted_amount", 2), digits=2),
    Kpi("win_rate", "deals", mean("is_won"), percent=True, digits=1),
    Kpi("avg_deal_size", "deals", mean("amount", 2), digits=2),
    Kpi("total_contacts", "contacts", rows()),
    Kpi("total_companies", "companies", rows()),
    Kpi("total_deals", "deals", rows()),
    Kpi("conversion_rate", "web_analytics", mean("conversion"), percent=True, digits=2),
    Kpi("bounce_rate", "web_analytics", mean("bounce"), percent=True, digits=1),
    Kpi("total_sessions", "web_analytics", rows()),
    Kpi("avg_csat", "support_tickets", mean("satisfaction_score"), digits=1),
    Kpi("sla_compliance", "support_tickets", mean("sla_met"), percent=True, digits=1),
    Kpi("total_tickets", "support_tickets", rows()),
    Kpi("email_open_rate", "email_campaigns", mean("is_opened"), percent=True, digits=1),
    Kpi("email_click_rate", "email_campaigns", mean("is_clicked"), percent=True, digits=1),
]
SOURCES = list(dict.fromkeys(kpi.source for kpi in KPIS))


def of_source(source: str) -> list[Kpi]:
    return [kpi for kpi in KPIS if kpi.source == source]


def columns_of(source: str) -> set[str]:
    """Entity columns the KPIs of an entity read."""
    return set().union(*[kpi.measure.source_columns for kpi in of_source(source)])


def _one_row(processed: DataFrame, kpis: list[Kpi]) -> DataFrame:
    inputs = all_inputs(kpi.measure for kpi in kpis)
    return processed.selectExpr(*inputs).selectExpr(
        *named({kpi.name: kpi.measure.combine() for kpi in kpis})
    )


def from_summary(kpi: Kpi) -> str:
    """Aggregate over summary rows that picks the KPI from the row of the whole table."""
    return f"max(CASE WHEN `grouping` = '{ALL_ROWS}' THEN {kpi.measure.name} END)"


def served(kpi: Kpi, value: str, present: bool) -> str:
    """The KPI as served: in percent where it is a rate, and rounded. 0 for an absent table; for
    an empty one sums and counts are 0 and means unknown."""
    if not present:
        return "0L" if kpi.digits is None else "0D"
    if kpi.measure.how != "mean":
        value = f"coalesce({value}, 0)"
    if kpi.digits is None:
        return f"CAST({value} AS BIGINT)"
    return round_exact(f"{value} * 100" if kpi.percent else value, kpi.digits)


def kpi_row(spark: SparkSession, processed: dict[str, DataFrame]) -> DataFrame:
    """One row of all KPIs from the processed entities that exist.

    Each entity is scanned once, for the columns its KPIs read. The one-row results are put side by
    side by a union and a final aggregate, so no join is involved.
    """
    present = [name for name in SOURCES if name in processed]
    merged = side_by_side(spark, [_one_row(processed[name], of_source(name)) for name in present])
    return merged.selectExpr(*named(
        {kpi.name: served(kpi, kpi.name, kpi.source in present) for kpi in KPIS}
    ))


def side_by_side(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """The columns of several one-row frames in one row."""
    if not parts:
        return spark.range(1)
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.selectExpr(*named({name: f"any_value({name}, true)" for name in union.columns}))


def records_loaded(kpi_frame: DataFrame) -> DataFrame:
    """Size of the core tables; marketing events and emails are not part of this figure."""
    return kpi_frame.selectExpr(
        "total_contacts + total_deals + total_sessions + total_tickets + total_companies"
        " AS records_loaded"
    )
