"""Every operator as a query over a directory of test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crmkiln import schemas
from crmkiln.operators import aggregates, charts, features, kpis, quality
from crmkiln.operators.aggregates import AGGREGATES
from crmkiln.operators.charts import CHARTS
from crmkiln.plans import dashboard, etl
from crmkiln.session import configured
from crmkiln.sources import tables
from crmkiln.sources.entity_views import entity

Query = Callable[[SparkSession, str], DataFrame]

def aggregate_query_name(name: str) -> str:
    return f"agg_{name}"


def chart_query_name(name: str) -> str:
    return f"chart_{name}"


def processed(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    return features.process(name, entity(spark, sf_dir, name, columns))


def aggregated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spec = AGGREGATES[name]
    return aggregates.aggregate(spec, processed(spark, sf_dir, spec.source, spec.columns))


def summaries(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        name: aggregates.summarize(
            name, processed(spark, sf_dir, name, aggregates.summary_columns(name))
        )
        for name in schemas.ENTITIES
    }


def chart_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    chart = CHARTS[name]
    return charts.chart_frame(chart, aggregated(spark, sf_dir, chart.aggregate))


def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.kpi_row(
        spark, {n: processed(spark, sf_dir, n, kpis.columns_of(n)) for n in kpis.SOURCES}
    )


def records_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.records_loaded(kpi_summary(spark, sf_dir))


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_rows(
        spark, {n: processed(spark, sf_dir, n, quality.columns_of(n)) for n in schemas.ENTITIES})


def layer_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch run: builds all layers and reports the rows of every table written. The layers
    go when they are counted."""
    root = tables.work_directory(spark, "layers")
    reports = etl.build(spark, root, lambda name: entity(spark, sf_dir, name))
    tables.remove(spark, root)
    return etl.report_frame(spark, reports).drop("seconds")


def raw_layers(
    spark: SparkSession, sf_dir: str, absent: tuple[str, ...] = (), keep_raw: bool = False
) -> str:
    """The batch run from raw files on, which are written first: all entities but the absent ones, the
    times of deals as text and those of web sessions as nanoseconds. Gives the folder to serve from."""
    root = tables.work_directory(spark, "layers")
    forms = {"deals": "CAST({0} AS STRING)", "web_analytics": "unix_micros(CAST({0} AS TIMESTAMP)) * 1000"}
    with configured(spark):
        entities = {name: entity(spark, sf_dir, name) for name in schemas.ENTITIES if name not in absent}
        for name, form in forms.items():
            if name in entities:
                time = schemas.TIME_COLUMN[name]
                entities[name] = entities[name].withColumn(time, F.expr(form.format(f"`{time}`")))
        tables.write_raw(entities, root)
    etl.run(spark, root)
    if not keep_raw:
        tables.remove(spark, f"{root}/{tables.RAW}")
    return root


def layer_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every stored aggregate, built from raw files: (name, key, measure, value)."""
    found = etl.stored(spark, raw_layers(spark, sf_dir), tables.AGGREGATED, AGGREGATES)
    parts = []
    for name, df in found.items():
        measures = AGGREGATES[name].measures
        values = ", ".join(f"'{alias}', CAST(`{alias}` AS DOUBLE)" for alias in measures)
        parts.append(df.selectExpr(
            f"'{name}' AS name", f"CAST({AGGREGATES[name].key} AS STRING) AS key",
            f"stack({len(measures)}, {values}) AS (measure, value)"))
    return reduce(DataFrame.unionByName, parts)


def layer_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chart as JSON from the stored aggregates of a run without marketing events."""
    root = raw_layers(spark, sf_dir, absent=("marketing_events",))
    return reduce(DataFrame.unionByName, [
        etl.serve_chart(spark, root, name).selectExpr(f"'{name}' AS chart", "payload") for name in CHARTS])


def layer_chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chart as rows from the stored aggregates of a run without deals, whose charts have no rows:
    (chart, position, label)."""
    root = raw_layers(spark, sf_dir, absent=("deals",))
    return reduce(DataFrame.unionByName, [
        etl.serve_rows(spark, root, name).selectExpr(
            f"'{name}' AS chart", "position", f"CAST(`{chart.label_name}` AS STRING) AS label")
        for name, chart in CHARTS.items()])


def layer_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written, and then served, when the raw contacts have changed since the batch run: those with a lead score
    below 50 are gone. (layer, name, rows); figures that are served have the layer ``served``."""
    root = raw_layers(spark, sf_dir, keep_raw=True)
    with configured(spark):
        tables.write_raw({"contacts": entity(spark, sf_dir, "contacts").where("lead_score >= 50")}, root)
    reports = etl.report_frame(spark, etl.refresh(spark, root)).drop("seconds")
    tables.remove(spark, f"{root}/{tables.RAW}")
    figures = ["total_contacts", "total_deals", "total_sessions"]
    served = etl.serve_kpis(spark, root).selectExpr(*[f"CAST({name} AS BIGINT) AS {name}" for name in figures])
    return reports.unionByName(served.unpivot([], figures, "name", "rows").selectExpr("'served' AS layer", "name", "rows"))


def layer_payload(spark: SparkSession, sf_dir: str, absent: tuple[str, ...] = ()) -> DataFrame:
    """The document from the stored summaries of a run over raw files."""
    return etl.serve_payload(spark, raw_layers(spark, sf_dir, absent))


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in schemas.ENTITIES:
        found[f"features_{name}"] = partial(processed, name=name)
    for name in AGGREGATES:
        found[aggregate_query_name(name)] = partial(aggregated, name=name)
    found["kpi_summary"] = kpi_summary
    for name in CHARTS:
        found[chart_query_name(name)] = partial(chart_rows, name=name)
    found.update({
        "dashboard_payload": lambda spark, d: dashboard.payload(spark, summaries(spark, d)),
        "dashboard_points": lambda spark, d: dashboard.points(spark, summaries(spark, d)),
        "deal_funnel": lambda spark, d: charts.funnel(
            chart_rows(spark, d, "deals_by_stage"), "counts"),
        "lifecycle_funnel": lambda spark, d: charts.funnel(
            chart_rows(spark, d, "contacts_lifecycle"), "count"),
        "page_traffic_share": lambda spark, d: charts.traffic_share(
            chart_rows(spark, d, "web_top_pages")),
        "top_industries": lambda spark, d: charts.top_industries(
            aggregated(spark, d, "deals_by_industry")),
        "records_loaded": records_loaded,
        "support_sla_bands": lambda spark, d: charts.sla_bands(
            chart_rows(spark, d, "support_by_category")),
        "channel_volume_k": lambda spark, d: charts.volume_in_thousands(
            chart_rows(spark, d, "marketing_channels")),
        "quality_checks": quality_checks,
        "layer_row_counts": layer_row_counts,
        "layer_aggregates": layer_aggregates,
        "layer_charts": layer_charts,
        "layer_chart_rows": layer_chart_rows,
        "layer_refresh": layer_refresh,
        "layer_payload": layer_payload,
        "layer_payload_without_deals": partial(layer_payload, absent=("deals",)),
    })
    return found
