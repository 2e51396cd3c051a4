"""The batch run: raw -> processed -> summaries -> aggregated.

Per entity the run makes three kinds of passes: one over the raw table (features, written once),
one pruned pass over the processed table (all of its aggregates at once, written as the
summary), and then only reads of that summary, which has one row per group. Every layer is a
written table, so a lost executor costs the tasks in flight and nothing upstream. A run publishes its
layers when all of them are written; whoever serves meanwhile sees those of the run before.

``run`` builds every entity; ``refresh`` only those whose raw files, or the rules of this library, have changed since
what is served was built, and refers to the tables of the others.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from crmkiln import labels, schemas
from crmkiln.functions import columns, measures
from crmkiln.operators import aggregates, features, kpis, quality
from crmkiln.operators.charts import CHARTS, chart_frame
from crmkiln.plans import dashboard
from crmkiln.session import configured
from crmkiln.sources import tables
from crmkiln.sources.tables import (
    AGGREGATED, PROCESSED, RAW, SUMMARIES, Holding, WriteReport, exists, fingerprint, hold, holder_path, holdings, load,
    new_version, publish, published, read_entity, read_if_present, remove, table_path, write_table,
)

#: What decides the layers of given raw files, besides the files.
_RULES = (labels, schemas, columns, measures, aggregates, features, tables)


def _build_entity(
    spark: SparkSession, root: str, source: Callable[[str], DataFrame | None], name: str
) -> list[WriteReport]:
    raw = source(name)
    if raw is None:
        return []
    reports = [write_table(features.process(name, raw), root, PROCESSED, name)]
    processed = spark.read.parquet(table_path(root, PROCESSED, name))
    reports.append(write_table(aggregates.summarize(name, processed), root, SUMMARIES, name))
    summary = spark.read.parquet(table_path(root, SUMMARIES, name))
    for spec in aggregates.of_source(name):
        table = aggregates.from_summary(spec, summary)
        reports.append(write_table(table, root, AGGREGATED, spec.name))
    return reports


def build(
    spark: SparkSession, root: str, source: Callable[[str], DataFrame | None],
    entities: Iterable[str] = schemas.ENTITIES,
) -> list[WriteReport]:
    """Build the layers of the entities under ``root``; ``source`` gives a raw entity, or None where there is none.
    Such entities are skipped, and so are their aggregates. A rerun gives the same tables.

    Entities do not depend on each other, so their jobs are submitted side by side: the small jobs
    and the stragglers of one entity run while another one scans. The first failure ends them all.
    """
    tag = f"layers-{uuid.uuid4().hex}"

    def job(name: str):
        @inheritable_thread_target(spark)
        def tagged():
            spark.addTag(tag)
            return _build_entity(spark, root, source, name)

        return tagged

    with ThreadPoolExecutor(max_workers=len(schemas.ENTITIES)) as pool:
        jobs = [pool.submit(job(name)) for name in entities]
        ended, running = wait(jobs, return_when=FIRST_EXCEPTION)
        if running:
            spark.interruptTag(tag)
            next(failed for failed in ended if failed.exception()).result()
        return [report for job in jobs for report in job.result()]


def _rules() -> str:
    """A hash of the code that makes the layers."""
    return hashlib.sha256("".join(map(inspect.getsource, _RULES)).encode()).hexdigest()


def _fingerprints(spark: SparkSession, raw_root: str) -> dict[str, str]:
    """Fingerprints of the raw entities that exist."""
    rules = _rules()
    found = {name: fingerprint(spark, table_path(raw_root, RAW, name), rules) for name in schemas.ENTITIES}
    return {name: mark for name, mark in found.items() if mark is not None}


def _publish_built(
    spark: SparkSession, root: str, raw_root: str, marks: dict[str, str], reused: dict[str, Holding]
) -> list[WriteReport]:
    """Build a version of the entities that are not reused, and publish it."""
    version = new_version(spark, root)
    own = version.rsplit("/", 1)[-1]
    with configured(spark):
        try:
            # Noted first: what a version at work refers to is not removed.
            for name, mark in marks.items():
                hold(spark, version, name, reused.get(name, Holding(mark, own)))
            reports = build(
                spark, version, lambda name: read_entity(spark, raw_root, name),
                [name for name in schemas.ENTITIES if name not in reused])
        except BaseException:
            remove(spark, version)
            raise
    publish(spark, root, version)
    return reports


def run(spark: SparkSession, root: str, raw_root: str | None = None) -> list[WriteReport]:
    """The batch run over the raw tables in ``<raw_root>/raw`` (``root`` by default). Its layers are
    published when all are written; a run that fails leaves what is served as it was."""
    raw_root = raw_root or root
    # Taken before the files are read: files that change meanwhile are new to the next refresh.
    with configured(spark):
        marks = _fingerprints(spark, raw_root)
    return _publish_built(spark, root, raw_root, marks, {})


def refresh(spark: SparkSession, root: str, raw_root: str | None = None) -> list[WriteReport]:
    """The batch run for the entities whose raw files have changed since what is served was built; the tables of the
    others stay where they are. Where nothing has changed, nothing is written and nothing published.

    An entity is unchanged while the names, sizes and times of its files and the library's rules are. Entities
    that are gone are served no more, and new ones are built. Served versions of former releases are built anew.
    """
    raw_root = raw_root or root
    with configured(spark):
        marks = _fingerprints(spark, raw_root)
    served = holdings(spark, published(spark, root))
    if marks and marks == {name: held.fingerprint for name, held in served.items()}:
        return []
    reused = {
        name: held for name, held in served.items()
        if marks.get(name) == held.fingerprint and exists(spark, f"{root.rstrip('/')}/versions/{held.holder}")}
    return _publish_built(spark, root, raw_root, marks, reused)


def report_frame(spark: SparkSession, reports: list[WriteReport]) -> DataFrame:
    """What a run wrote: one row per table."""
    rows = [(r.layer, r.name, r.rows, r.seconds) for r in reports]
    return spark.createDataFrame(rows, "layer string, name string, rows long, seconds double")


def stored_path(spark: SparkSession, root: str, layer: str, name: str) -> str:
    """Where a published table lies, or would."""
    entity = aggregates.AGGREGATES[name].source if layer == AGGREGATED else name
    return table_path(holder_path(spark, root, published(spark, root), entity), layer, name)


def stored(spark: SparkSession, root: str, layer: str, names) -> dict[str, DataFrame]:
    """The published tables of a layer that exist."""
    version = published(spark, root)
    held = holdings(spark, version)
    folders = {name: f"{root.rstrip('/')}/versions/{found.holder}" for name, found in held.items()}
    found = {}
    for name in names:
        entity = aggregates.AGGREGATES[name].source if layer == AGGREGATED else name
        found[name] = read_if_present(spark, table_path(folders.get(entity, version), layer, name))
    return {name: df for name, df in found.items() if df is not None}


def serve_payload(spark: SparkSession, root: str) -> DataFrame:
    """The dashboard document from the stored summaries; no entity is scanned."""
    return dashboard.payload(spark, stored(spark, root, SUMMARIES, schemas.ENTITIES))


def serve_kpis(spark: SparkSession, root: str) -> DataFrame:
    """The KPI row from the stored summaries; no entity is scanned."""
    return dashboard.kpi_row(spark, stored(spark, root, SUMMARIES, kpis.SOURCES))


def serve_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One chart as rows from its stored aggregate; no rows where the aggregate is absent."""
    chart = CHARTS[name]
    path = stored_path(spark, root, AGGREGATED, chart.aggregate)
    return chart_frame(chart, load(spark, path, chart.spec.schema))


def serve_chart(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One chart as JSON from its stored aggregate."""
    chart = CHARTS[name]
    path = stored_path(spark, root, AGGREGATED, chart.aggregate)
    return dashboard.chart_json(spark, chart, read_if_present(spark, path))


def check_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality checks over the stored processed tables and the stored aggregates."""
    return quality.check(
        spark, stored(spark, root, PROCESSED, schemas.ENTITIES),
        quality.filled_tables(stored(spark, root, AGGREGATED, aggregates.AGGREGATES)))


def export_json(spark: SparkSession, root: str) -> list[str]:
    """Write every served document as JSON text under ``<root>/json``: the dashboard, the KPIs and
    each chart. Returns their names."""
    documents = {
        "dashboard": serve_payload(spark, root),
        "kpis": dashboard.kpi_json(serve_kpis(spark, root)),
        **{name: serve_chart(spark, root, name) for name in CHARTS},
    }
    for name, document in documents.items():
        dashboard.write_json(document, f"{root.rstrip('/')}/json/{name}")
    return list(documents)
