"""The layered batch run over raw files."""

import datetime as dt
import glob
import json
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

import pytest

from compare import spark_table
from crmkiln import schemas
from crmkiln.operators import aggregates, quality
from crmkiln.operators.aggregates import AGGREGATES
from crmkiln.operators.charts import CHARTS
from crmkiln.plans import dashboard, etl
from crmkiln.plans.queries import (
    aggregated, chart_rows, kpi_summary, processed, quality_checks, summaries,
)
from crmkiln.sources import tables
from crmkiln.sources.entity_views import entity


@pytest.fixture(scope="module")
def root(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layers"))
    entities = {name: entity(spark, sf_dir, name) for name in schemas.ENTITIES}
    written = tables.write_raw(entities, root)
    assert [report.name for report in written] == schemas.ENTITIES
    assert all(report.rows > 0 for report in written)
    return root


@pytest.fixture(scope="module")
def reports(spark, root):
    return etl.run(spark, root)


def read(spark, root, layer, name):
    return spark.read.parquet(tables.table_path(tables.published(spark, root), layer, name))


def test_every_table_is_written_and_counted(spark, root, reports):
    assert {(r.layer, r.name) for r in reports} == (
        {(layer, name) for layer in ("processed", "summaries") for name in schemas.ENTITIES}
        | {("aggregated", name) for name in AGGREGATES}
    )
    for report in reports:
        assert report.rows == read(spark, root, report.layer, report.name).count()
        assert report.seconds > 0
    frame = etl.report_frame(spark, reports)
    assert frame.columns == ["layer", "name", "rows", "seconds"]
    assert frame.count() == len(reports)


def test_layers_equal_the_direct_queries(spark, sf_dir, root, reports):
    for name in schemas.ENTITIES:
        assert spark_table(read(spark, root, "processed", name)) == spark_table(
            processed(spark, sf_dir, name))
    for name in AGGREGATES:
        assert spark_table(read(spark, root, "aggregated", name)) == spark_table(
            aggregated(spark, sf_dir, name))


def test_serving_from_the_layers(spark, sf_dir, root, reports, tmp_path):
    expected = dashboard.payload(spark, summaries(spark, sf_dir)).first().payload
    assert etl.serve_payload(spark, root).first().payload == expected
    assert etl.serve_kpis(spark, root).first() == kpi_summary(spark, sf_dir).first()
    document = json.loads(expected)
    for name in ("deals_by_region", "web_by_country", "email_by_hour", "marketing_trend"):
        assert json.loads(etl.serve_chart(spark, root, name).first().payload) == document[name]
    path = str(tmp_path / "kpis")
    dashboard.write_json(dashboard.kpi_json(etl.serve_kpis(spark, root)), path)
    assert json.loads(spark.read.text(path).first().value) == document["kpis"]


def test_json_export(spark, root, reports):
    names = etl.export_json(spark, root)
    assert names == ["dashboard", "kpis", *CHARTS]
    read_json = lambda name: json.loads(spark.read.text(f"{root}/json/{name}").first().value)
    whole = read_json("dashboard")
    assert {name: read_json(name) for name in ["kpis", *CHARTS]} == whole


def test_rows_from_the_layers(spark, sf_dir, root, reports, tmp_path):
    for name in ("email_by_hour", "revenue_trend"):
        assert spark_table(etl.serve_rows(spark, root, name)) == spark_table(
            chart_rows(spark, sf_dir, name))
        absent = etl.serve_rows(spark, str(tmp_path), name)
        assert absent.count() == 0
        assert absent.dtypes == chart_rows(spark, sf_dir, name).dtypes


def test_quality_sees_stored_aggregates(spark, root, reports):
    """An emptied and a removed aggregate are violations, though their entity is whole."""
    found = etl.stored(spark, root, tables.AGGREGATED, ["deals_by_region", "deals_by_industry"])
    found["deals_by_region"] = found["deals_by_region"].where("false")
    checked = {row.check: row.violations for row in quality.check(
        spark, {}, quality.filled_tables(found)).collect()}
    assert checked["deals_by_region is not empty"] == 1
    assert checked["deals_by_industry is not empty"] == 0
    assert checked["web_by_page is not empty"] == 1


def test_quality_of_the_layers(spark, sf_dir, root, reports):
    assert spark_table(etl.check_quality(spark, root)) == spark_table(quality_checks(spark, sf_dir))


def test_declared_schemas_are_those_written(spark, root, reports):
    for name, spec in AGGREGATES.items():
        written = read(spark, root, "aggregated", name)
        assert written.dtypes == [(f.name, f.dataType.simpleString()) for f in spec.schema.fields]


def test_a_rerun_gives_the_same_tables(spark, root, reports):
    before = {name: spark_table(read(spark, root, "aggregated", name)) for name in AGGREGATES}
    again = etl.run(spark, root)
    assert [(r.layer, r.name, r.rows) for r in again] == [
        (r.layer, r.name, r.rows) for r in reports]
    for name, table in before.items():
        assert spark_table(read(spark, root, "aggregated", name)) == table


def test_aggregates_are_one_small_file(spark, root, reports):
    for name in AGGREGATES:
        folder = tables.table_path(tables.published(spark, root), "aggregated", name)
        assert len(glob.glob(f"{folder}/*.snappy.parquet")) == 1


def test_absent_entities_are_skipped(spark, sf_dir, tmp_path):
    root = str(tmp_path)
    tables.write_raw({"contacts": entity(spark, sf_dir, "contacts")}, root)
    written = etl.run(spark, root)
    assert {(r.layer, r.name) for r in written} == {
        ("processed", "contacts"), ("summaries", "contacts"),
        ("aggregated", "contacts_by_lifecycle"), ("aggregated", "contacts_by_source"),
    }
    document = json.loads(etl.serve_payload(spark, root).first().payload)
    assert document["kpis"]["total_sessions"] == 0
    assert document["web_trend"] == {"labels": [], "datasets": []}
    assert document["contacts_lifecycle"]["labels"]
    absent = json.loads(etl.serve_chart(spark, root, "web_top_pages").first().payload)
    assert absent == {"labels": [], "data": []}


def test_load_of_an_absent_table_is_empty(spark, tmp_path):
    df = tables.load(spark, str(tmp_path / "none.parquet"), schemas.RAW["deals"])
    assert df.count() == 0 and df.columns == schemas.RAW["deals"].names


def write_pandas(root, name, df, **options):
    folder = root / "raw"
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.Table.from_pandas(df, preserve_index=False), folder / f"{name}.parquet", **options)


def tickets(n=4):
    start = pd.Timestamp("2023-03-31 23:30:00.123456")
    return pd.DataFrame({
        "ticket_id": np.arange(n), "contact_id": 1, "company_id": 1, "category": "Billing",
        "priority": "Low", "status": "Open", "resolution_hours": [1.5, np.nan, 200.0, 2.5][:n],
        "satisfaction_score": 5, "num_interactions": 1,
        "created_at": [start + pd.Timedelta(hours=i) for i in range(n)],
    })


def test_nanosecond_files_and_nan(spark, tmp_path):
    write_pandas(tmp_path, "support_tickets", tickets(), version="2.6")
    schema = pq.read_schema(tmp_path / "raw" / "support_tickets.parquet")
    assert schema.field("created_at").type == pa.timestamp("ns")
    etl.run(spark, str(tmp_path))
    rows = read(spark, str(tmp_path), "processed", "support_tickets").orderBy("ticket_id").collect()
    assert rows[0].created_at == dt.datetime(2023, 3, 31, 23, 30, 0, 123456)
    assert [row.quarter for row in rows] == ["2023Q1", "2023Q2", "2023Q2", "2023Q2"]
    assert [row.sla_met for row in rows] == [1, 0, 0, 1]
    assert rows[1].resolution_hours is None
    by_category = read(spark, str(tmp_path), "aggregated", "support_by_category").first()
    assert by_category.avg_resolution_hours == 68.0


def test_nanoseconds_before_the_epoch(spark, tmp_path):
    df = tickets(1)
    df["created_at"] = pd.to_datetime(["1969-12-31 23:59:59.999999500"])
    write_pandas(tmp_path, "support_tickets", df, version="2.6")
    raw = tables.read_entity(spark, str(tmp_path), "support_tickets")
    assert raw.first().created_at == dt.datetime(1969, 12, 31, 23, 59, 59, 999999)


def test_missing_column_is_an_error(spark, tmp_path):
    write_pandas(tmp_path, "support_tickets", tickets().drop(columns=["priority", "status"]))
    with pytest.raises(ValueError, match="priority, status"):
        tables.read_entity(spark, str(tmp_path), "support_tickets")


def test_extra_columns_pass_through(spark, tmp_path):
    write_pandas(tmp_path, "support_tickets", tickets().assign(**{"owner name": "kim"}))
    raw = tables.read_entity(spark, str(tmp_path), "support_tickets")
    assert raw.first()["owner name"] == "kim"
    etl.run(spark, str(tmp_path))
    assert read(spark, str(tmp_path), "processed", "support_tickets").first()["owner name"] == "kim"


def test_other_read_errors_are_not_taken_for_absence(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "deals.parquet").write_text("not a parquet file")
    with pytest.raises(Exception, match="not a Parquet file|CANNOT_READ_FILE_FOOTER"):
        tables.read_entity(spark, str(tmp_path), "deals")


def test_served_figures_outlive_a_failed_run(spark, sf_dir, tmp_path):
    root = str(tmp_path)
    tables.write_raw({name: entity(spark, sf_dir, name) for name in ("contacts", "companies")}, root)
    etl.run(spark, root)
    before = etl.serve_kpis(spark, root).first()
    opened = etl.serve_rows(spark, root, "contacts_by_source")  # read before, collected after the reruns
    held = spark_table(etl.serve_rows(spark, root, "contacts_by_source"))
    write_pandas(tmp_path, "support_tickets", tickets().drop(columns=["priority"]))
    with pytest.raises(ValueError, match="priority"):
        etl.run(spark, root)
    assert etl.serve_kpis(spark, root).first() == before and before.total_contacts > 0
    write_pandas(tmp_path, "support_tickets", tickets())
    etl.run(spark, root)
    assert spark_table(opened) == held
    assert etl.serve_kpis(spark, root).first().total_tickets == 4
    assert len(list((tmp_path / "versions").iterdir())) == 2


def built(root, version, mark):
    """A version of one file, without a Spark job."""
    folder = root / "versions" / version.rsplit("/", 1)[-1]
    folder.mkdir(parents=True)
    (folder / mark).write_text(mark)


def test_the_run_that_ends_last_is_served(spark, tmp_path):
    root = str(tmp_path)
    early, late = tables.new_version(spark, root), tables.new_version(spark, root)
    built(tmp_path, early, "early")
    built(tmp_path, late, "late")
    tables.publish(spark, root, late)
    assert tables.published(spark, root) == late
    tables.publish(spark, root, early)
    assert tables.published(spark, root) == early
    for _ in range(2):
        newest = tables.new_version(spark, root)
        built(tmp_path, newest, "newest")
        tables.publish(spark, root, newest)
        assert tables.published(spark, root) == newest
    assert early.rsplit("/", 1)[-1] not in {found.name for found in (tmp_path / "versions").iterdir()}
    assert len(list((tmp_path / "versions").iterdir())) == 2


def test_claims_of_killed_runs_do_not_hold_up_others(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "claims").mkdir()
    (tmp_path / "claims" / f"{1:020d}").write_text("")  # a run that was killed before it published
    version = tables.new_version(spark, root)
    built(tmp_path, version, "whole")
    tables.publish(spark, root, version)
    assert tables.published(spark, root) == version


def test_versions_of_killed_runs_are_removed(spark, tmp_path):
    root = str(tmp_path)
    killed = f"{root}/versions/{time.time_ns() - 8 * 86400 * 10**9:020d}-killed"
    running, done = tables.new_version(spark, root), tables.new_version(spark, root)
    for version in (killed, running, done):
        built(tmp_path, version, "part")
    tables.publish(spark, root, done)
    assert {found.name for found in (tmp_path / "versions").iterdir()} == {
        running.rsplit("/", 1)[-1], done.rsplit("/", 1)[-1]}


def test_a_store_of_a_former_release_goes_on(spark, tmp_path):
    root = str(tmp_path)
    former, version = tables.new_version(spark, root), tables.new_version(spark, root)
    built(tmp_path, former, "former")
    (tmp_path / "published").mkdir()
    (tmp_path / "published" / former.rsplit("/", 1)[-1]).write_text("")
    assert tables.published(spark, root) == former
    built(tmp_path, version, "whole")
    tables.publish(spark, root, version)
    assert tables.published(spark, root) == version


def versions_of(root):
    return {found.name for found in (root / "versions").iterdir()}


def test_refresh_builds_what_has_changed(spark, sf_dir, tmp_path):
    root = str(tmp_path)
    tables.write_raw({name: entity(spark, sf_dir, name) for name in ("contacts", "companies")}, root)
    assert {r.name for r in etl.refresh(spark, root) if r.layer == "processed"} == {"contacts", "companies"}
    first, before = tables.published(spark, root), etl.serve_kpis(spark, root).first()
    files = sorted(glob.glob(f"{root}/versions/**/*", recursive=True))
    assert etl.refresh(spark, root) == []
    assert tables.published(spark, root) == first
    assert sorted(glob.glob(f"{root}/versions/**/*", recursive=True)) == files

    tables.write_raw({"contacts": entity(spark, sf_dir, "contacts").where("lead_score >= 50")}, root)
    assert {(r.layer, r.name) for r in etl.refresh(spark, root)} == {
        ("processed", "contacts"), ("summaries", "contacts"),
        ("aggregated", "contacts_by_lifecycle"), ("aggregated", "contacts_by_source")}
    second = tables.published(spark, root)
    assert not glob.glob(f"{second}/*/companies*.parquet") and glob.glob(f"{second}/*/contacts*.parquet")
    after = etl.serve_kpis(spark, root).first()
    assert 0 < after.total_contacts < before.total_contacts
    assert {name: df.count() for name, df in etl.stored(spark, root, "processed", schemas.ENTITIES).items()} == {
        "contacts": after.total_contacts, "companies": entity(spark, sf_dir, "companies").count()}
    of_companies = next(name for name, chart in CHARTS.items() if chart.spec.source == "companies")
    assert etl.serve_rows(spark, root, of_companies).count() > 0

    # Later refreshes keep the version that still holds the companies, and drop it when it holds nothing.
    for score in (60, 70):
        tables.write_raw({"contacts": entity(spark, sf_dir, "contacts").where(f"lead_score >= {score}")}, root)
        etl.refresh(spark, root)
    assert first.rsplit("/", 1)[-1] in versions_of(tmp_path) and second.rsplit("/", 1)[-1] not in versions_of(tmp_path)
    for _ in range(2):
        etl.run(spark, root)
    assert len(versions_of(tmp_path)) == 2 and first.rsplit("/", 1)[-1] not in versions_of(tmp_path)

    # An entity that is gone is served no more.
    tables.remove(spark, tables.table_path(root, tables.RAW, "companies"))
    assert etl.refresh(spark, root) == []
    assert set(etl.stored(spark, root, "processed", schemas.ENTITIES)) == {"contacts"}


def test_refresh_follows_the_rules(spark, sf_dir, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.write_raw({"companies": entity(spark, sf_dir, "companies")}, root)
    built_first = [(r.layer, r.name, r.rows) for r in etl.run(spark, root)]
    assert etl.refresh(spark, root) == []
    monkeypatch.setattr(etl, "_rules", lambda: "other rules")
    assert [(r.layer, r.name, r.rows) for r in etl.refresh(spark, root)] == built_first


def test_a_version_whose_tables_are_gone_is_not_published(spark, tmp_path):
    root = str(tmp_path)
    served, version = tables.new_version(spark, root), tables.new_version(spark, root)
    built(tmp_path, served, "whole")
    tables.publish(spark, root, served)
    built(tmp_path, version, "part")
    tables.hold(spark, version, "deals", tables.Holding("mark", "gone"))
    with pytest.raises(FileNotFoundError, match="gone"):
        tables.publish(spark, root, version)
    assert tables.published(spark, root) == served


def test_a_run_leaves_the_session_as_found(spark, sf_dir, tmp_path):
    tables.write_raw({"contacts": entity(spark, sf_dir, "contacts")}, str(tmp_path))
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        before = dict(spark.conf.getAll)
        etl.run(spark, str(tmp_path))
        assert dict(spark.conf.getAll) == before
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_lookup_that_is_not_joined_has_no_columns(spark, sf_dir):
    assert "region" not in processed(spark, sf_dir, "deals", {"amount"}).columns
    assert "country" not in processed(spark, sf_dir, "web_analytics", {"bounce"}).columns


def test_totals_of_the_summary_match_the_aggregates(spark, root, reports):
    summary = read(spark, root, "summaries", "deals")
    whole = summary.where("`grouping` = 'all'").first()
    parts = aggregates.from_summary(AGGREGATES["pipeline_stages"], summary).collect()
    assert whole["rows"] == sum(row["count"] for row in parts)
