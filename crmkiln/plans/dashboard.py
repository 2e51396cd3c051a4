"""The combined dashboard document and its JSON forms.

The document is built from the per-entity summaries: every entity is scanned once for all of its
charts and KPIs. A summary has one row per chart label, of which a chart with a limit keeps its first ones; each
entity then folds into a single row of lists, and the entities are put side by side by a union and a final
aggregate (no join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crmkiln.functions.columns import text
from crmkiln.functions.measures import named
from crmkiln.operators import kpis
from crmkiln.operators.aggregates import belongs, key_of
from crmkiln.operators.charts import CHARTS, Chart, Series, shown


def _struct(fields: dict[str, str]) -> str:
    pairs = ", ".join(f"{text(name)}, {expression}" for name, expression in fields.items())
    return f"named_struct({pairs})"


def _json(document: str) -> str:
    return f"to_json({document}, map('ignoreNullFields', 'false')) AS payload"


def _ordered_rows(chart: Chart, member: str, key: str, measure: Callable[[str], str]) -> str:
    """Aggregate: the chart's rows as an ordered array of (label, series...)."""
    row = _struct({
        "sort_key": chart.sort_key(key, measure),
        "key": key,
        "label": chart.label(key),
        **{s.name: s.value(measure(s.measure)) for s in chart.series},
    })
    return f"sort_array(collect_list(CASE WHEN {member} THEN {row} END))"


def _from_summary(chart: Chart) -> str:
    """The ordered rows of a chart as an aggregate over the summary of its entity."""
    spec = chart.spec
    return _ordered_rows(
        chart, belongs(spec), key_of(spec), lambda alias: spec.measures[alias].name
    )


def _limited(source: str, summary: DataFrame) -> DataFrame:
    """The summary without the groups that a chart with a limit does not show. Spark plans the condition on the rank
    as a limit per task and group before the exchange; all other summary rows are groups of one."""
    for chart in _charts_of(source):
        if chart.top is None:
            continue
        spec = chart.spec
        group = f"CASE WHEN {belongs(spec)} THEN '' ELSE concat(`grouping`, ' ', key) END"
        order = [chart.sort_key(key_of(spec), lambda alias: spec.measures[alias].name), key_of(spec)]
        within = ", ".join(f"CASE WHEN {belongs(spec)} THEN {expression} END" for expression in order)
        rank = f"row_number() OVER (PARTITION BY {group} ORDER BY {within}) AS __rank"
        summary = summary.selectExpr("*", rank).where(f"__rank <= {chart.top}").drop("__rank")
    return summary


def _document(chart: Chart, rows: str) -> str:
    """Parallel lists of a chart, in the shape it is served in."""
    if not chart.titled:
        return _struct({
            "labels": f"{rows}.label", **{s.name: f"{rows}.`{s.name}`" for s in chart.series}
        })
    # VARIANT lets whole and decimal lists share one array.
    datasets = ", ".join(
        f"to_variant_object({_struct({'label': text(s.title), 'data': f'{rows}.`{s.name}`'})})"
        for s in chart.series
    )
    return _struct({"labels": f"{rows}.label", "datasets": f"array({datasets})"})


def _absent(chart: Chart) -> str:
    """What a chart looks like when its table is absent."""
    return _struct({"labels": "array()", "datasets" if chart.titled else "data": "array()"})


def _charts_of(source: str) -> list[Chart]:
    return [chart for chart in CHARTS.values() if chart.spec.source == source]


def _folded(spark: SparkSession, summaries: dict[str, DataFrame]) -> DataFrame:
    """One row with the ordered rows of every chart and the raw value of every KPI."""
    parts = [
        _limited(source, summary).selectExpr(*named({
            **{chart.name: _from_summary(chart) for chart in _charts_of(source)},
            **{f"kpi_{k.name}": kpis.from_summary(k) for k in kpis.of_source(source)},
        }))
        for source, summary in summaries.items()
    ]
    return kpis.side_by_side(spark, parts)


def _figures(summaries: dict[str, DataFrame]) -> dict[str, str]:
    return {k.name: kpis.served(k, f"kpi_{k.name}", k.source in summaries) for k in kpis.KPIS}


def kpi_row(spark: SparkSession, summaries: dict[str, DataFrame]) -> DataFrame:
    """The KPI row from the summaries of the entities that exist."""
    parts = [
        summary.selectExpr(*named({f"kpi_{k.name}": kpis.from_summary(k) for k in found}))
        for source, summary in summaries.items()
        if (found := kpis.of_source(source))
    ]
    return kpis.side_by_side(spark, parts).selectExpr(*named(_figures(summaries)))


def payload(spark: SparkSession, summaries: dict[str, DataFrame]) -> DataFrame:
    """One row, one column ``payload``: the KPIs and all charts as a JSON document.

    ``summaries`` maps each entity that exists to its summary.
    """
    figures = _figures(summaries)
    charts = {
        name: _document(chart, name) if chart.spec.source in summaries else _absent(chart)
        for name, chart in CHARTS.items()
    }
    return _folded(spark, summaries).selectExpr(_json(_struct({"kpis": _struct(figures), **charts})))


def _series_points(chart: Chart, series: Series) -> str:
    """One list of a chart as an array of points."""
    point = _struct({
        "chart": text(chart.name),
        "position": "CAST(place + 1 AS BIGINT)",
        "label": "CAST(row.label AS STRING)",
        "series": text(series.name),
        "value": f"CAST(row.`{series.name}` AS DOUBLE)",
    })
    return f"transform({chart.name}, (row, place) -> {point})"


def points(spark: SparkSession, summaries: dict[str, DataFrame]) -> DataFrame:
    """The charts of the document as rows: (chart, position, label, series, value)."""
    lists = ", ".join(
        _series_points(chart, series)
        for chart in CHARTS.values()
        if chart.spec.source in summaries
        for series in chart.series
    )
    return _folded(spark, summaries).selectExpr(f"inline(flatten(array({lists})))")


def chart_json(spark: SparkSession, chart: Chart, aggregated: DataFrame | None) -> DataFrame:
    """One row, one column ``payload``: a single chart as JSON, from its aggregate table."""
    if aggregated is None:
        return spark.range(1).selectExpr(_json(_absent(chart)))
    key = chart.spec.key
    rows = _ordered_rows(chart, "true", key, lambda alias: f"`{alias}`")
    return shown(chart, aggregated).selectExpr(f"{rows} AS rows").selectExpr(_json(_document(chart, "rows")))


def kpi_json(kpi_frame: DataFrame) -> DataFrame:
    """The KPI row as JSON."""
    return kpi_frame.selectExpr(_json("struct(*)"))


def write_json(document: DataFrame, path: str) -> None:
    """Write a one-row JSON document as text."""
    document.write.mode("overwrite").text(path)
