"""Data-quality checks: rules over the rows of an entity, and that every aggregate has rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from crmkiln import labels
from crmkiln.functions.columns import text
from crmkiln.operators import aggregates

# Rules that hold for every row.
RULES: dict[str, dict[str, str]] = {
    "companies": {
        "companies.company_id is present": "company_id IS NOT NULL",
        "companies.company_age is not negative": "company_age >= 0",
    },
    "contacts": {
        "contacts.contact_id is present": "contact_id IS NOT NULL",
        "contacts.engagement_index is within its cap":
            f"engagement_index <= {labels.ENGAGEMENT_CAP}",
    },
    "deals": {
        "deals.deal_id is present": "deal_id IS NOT NULL",
        "deals.weighted_amount is not negative": "weighted_amount >= 0",
        "deals.is_won is 0 or 1": "is_won IN (0, 1)",
    },
    "support_tickets": {"support_tickets.sla_met is 0 or 1": "sla_met IN (0, 1)"},
}


def columns_of(source: str) -> set[str]:
    """Columns that the checks of an entity read: those of its rules, and the keys of its aggregates."""
    keys = {spec.key for spec in aggregates.of_source(source)}
    return keys | {
        column for column in ("company_id", "company_age", "contact_id", "engagement_index", "deal_id",
                              "weighted_amount", "is_won", "sla_met")
        if any(column in rule for rule in RULES.get(source, {}).values())
    }


def _rows(checks: dict[str, str]) -> str:
    rows = ", ".join(
        f"named_struct('check', {text(name)}, 'violations', {violations})"
        for name, violations in checks.items()
    )
    return f"array({rows}) AS checks"


def _filled(name: str) -> str:
    return f"{name} is not empty"


def _violations(source: str) -> dict[str, str]:
    # A rule that is not known to hold is violated.
    return {
        name: f"count_if(NOT coalesce({rule}, false))" for name, rule in RULES.get(source, {}).items()
    }


def _unfilled(source: str) -> dict[str, str]:
    """An aggregate has a group exactly where some row of its entity has its key."""
    return {
        _filled(spec.name): f"if(count_if({spec.keyed}) > 0, 0L, 1L)"
        for spec in aggregates.of_source(source)
    }


def _checked(processed: DataFrame, checks: dict[str, str]) -> DataFrame:
    return processed.selectExpr(_rows(checks)).selectExpr("inline(checks)")


def filled_tables(aggregated: dict[str, DataFrame]) -> list[DataFrame]:
    """Checks of stored aggregate tables: one row of each is looked for, none is counted whole."""
    return [
        df.limit(1).selectExpr(_rows({_filled(name): "1 - count(1)"})).selectExpr("inline(checks)")
        for name, df in aggregated.items()
    ]


def filled_summaries(summaries: dict[str, DataFrame]) -> list[DataFrame]:
    """The same of the aggregates that summaries hold: one pass over each summary."""
    return [
        summary.selectExpr(_rows({
            _filled(spec.name): f"if(count_if({aggregates.belongs(spec)}) > 0, 0L, 1L)"
            for spec in aggregates.of_source(source)
        })).selectExpr("inline(checks)")
        for source, summary in summaries.items()
    ]


def check(spark: SparkSession, processed: dict[str, DataFrame], filled: list[DataFrame]) -> DataFrame:
    """All checks: (check, violations). What is absent is one violation of each of its checks.

    ``processed``: the entities that exist; ``filled``: the checks of their aggregates.
    """
    rules = [_checked(df, _violations(source)) for source, df in processed.items() if source in RULES]
    return _report(spark, rules + filled)


def check_rows(spark: SparkSession, processed: dict[str, DataFrame]) -> DataFrame:
    """All checks from the entities that exist alone: one scan of each, of the columns its checks read, and one
    exchanged row per task; no aggregate is computed."""
    return _report(spark, [
        _checked(df, {**_violations(source), **_unfilled(source)}) for source, df in processed.items()])


def _report(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    names = [name for rules in RULES.values() for name in rules]
    names += [_filled(name) for name in aggregates.AGGREGATES]
    every = spark.createDataFrame([(name,) for name in names], "check string")
    if not parts:
        return every.selectExpr("check", "1L AS violations")
    found = reduce(DataFrame.unionByName, parts)
    return every.join(found, "check", "left").selectExpr("check", "coalesce(violations, 1L) AS violations")
