"""Chart datasets: order, ties, limits, scaling, JSON shapes."""

import json

from crmkiln.operators import aggregates, charts, features
from crmkiln.operators.aggregates import AGGREGATES
from crmkiln.operators.charts import CHARTS
from crmkiln.plans import dashboard
from crmkiln.plans.queries import chart_rows, kpi_summary, summaries
from fixtures import deal, entity, session, ticket


def aggregated(spark, name, rows):
    spec = AGGREGATES[name]
    df = features.process(spec.source, entity(spark, spec.source, rows))
    return aggregates.aggregate(spec, df)


def frame_of(spark, chart_name, rows):
    chart = CHARTS[chart_name]
    return charts.chart_frame(chart, aggregated(spark, chart.aggregate, rows))


def frame(spark, chart_name, rows):
    return frame_of(spark, chart_name, rows).orderBy("position").collect()


def test_stage_order_with_unknown_stage_last(spark):
    stages = ["Closed Lost", "Other", "Prospecting", "Another", "Closed Won"]
    got = frame(spark, "deals_by_stage", [deal(i, stage=s) for i, s in enumerate(stages)])
    assert [row.stage for row in got] == [
        "Prospecting", "Closed Won", "Closed Lost", "Another", "Other",
    ]
    assert [row.position for row in got] == [1, 2, 3, 4, 5]


def test_ties_are_settled_by_label(spark):
    got = frame(spark, "deals_by_region", [
        deal(1, region="B"), deal(2, region="A"), deal(3, region="C", amount=900.0),
    ])
    assert [row.region for row in got] == ["C", "A", "B"]


def test_top_fifteen_countries(spark):
    rows = [session(i, country=f"C{i:02d}") for i in range(17)] + [session(99, country="C16")]
    got = frame(spark, "web_by_country", rows)
    assert [row.country for row in got] == ["C16"] + [f"C{i:02d}" for i in range(14)]


def test_all_pages_are_shown(spark):
    rows = [session(i, page_url=f"/{i:02d}") for i in range(40)]
    assert len(frame(spark, "web_top_pages", rows)) == 40


def test_a_million_pages_are_ranked_in_many_tasks(spark):
    pages = spark.range(1_000_000).selectExpr(
        "concat('/', id) AS page_url", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 1000 END AS sessions",
        "0.5D AS bounce_rate", "0.25D AS conversion_rate", "id AS unread")
    df = charts.chart_frame(CHARTS["web_top_pages"], pages)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert all("__part" in line for line in text.splitlines() if " Window [" in line)
    got = df.select("position", "page_url", "sessions").toPandas().sort_values("position")
    assert list(got.position) == list(range(1, 1_000_001))
    rows = list(zip(-got.sessions, got.page_url))
    assert rows == sorted(rows)


def test_no_pages(spark):
    df = charts.traffic_share(frame_of(spark, "web_top_pages", []))
    assert df.collect() == [] and df.columns[-1] == "traffic_share"


def test_rates_are_percent_and_rounded(spark):
    rows = [session(i, bounce=int(i < 1), conversion=int(i < 2)) for i in range(7)]
    row = frame(spark, "web_top_pages", rows)[0]
    assert (row.sessions, row.bounce_rate, row.conversion_rate) == (7, 14.3, 28.57)


def test_top_ten_industries(spark):
    rows = [deal(i, industry=f"I{i:02d}", amount=100.0 * i) for i in range(1, 13)]
    df = charts.top_industries(aggregated(spark, "deals_by_industry", rows))
    got = df.orderBy("position").collect()
    assert [row.industry for row in got] == [f"I{i:02d}" for i in range(12, 2, -1)]
    assert df.columns == ["position", "industry", "revenue", "win_rate"]


def test_funnel_has_a_minimum_width(spark):
    rows = [deal(i, stage="Proposal") for i in range(20)] + [deal(99, stage="Closed Won")]
    chart = CHARTS["deals_by_stage"]
    df = charts.chart_frame(chart, aggregated(spark, chart.aggregate, rows))
    got = {row.stage: row.width for row in charts.funnel(df, "counts").collect()}
    assert got == {"Proposal": 100.0, "Closed Won": 8.0}


def test_traffic_share(spark):
    rows = [session(1), session(2), session(3, page_url="/docs")]
    chart = CHARTS["web_top_pages"]
    df = charts.chart_frame(chart, aggregated(spark, chart.aggregate, rows))
    got = {row.page_url: row.traffic_share for row in charts.traffic_share(df).collect()}
    assert got == {"/": 100.0, "/docs": 50.0}


def test_sla_bands(spark):
    rows = []
    for met, category in ((7, "good"), (6, "warning"), (5, "edge"), (4, "bad")):
        rows += [ticket(i, category=category, resolution_hours=1.0 if i < met else 999.0)
                 for i in range(10)]
    chart = CHARTS["support_by_category"]
    df = charts.chart_frame(chart, aggregated(spark, chart.aggregate, rows))
    got = {row.category: row.sla_band for row in charts.sla_bands(df).collect()}
    assert got == {"good": "good", "warning": "warning", "edge": "warning", "bad": "bad"}


def test_dashboard_document_holds_every_chart(spark, sf_dir):
    text = dashboard.payload(spark, summaries(spark, sf_dir)).first().payload
    document = json.loads(text)
    assert list(document) == ["kpis", *CHARTS]
    assert document["kpis"] == kpi_summary(spark, sf_dir).first().asDict()
    for name, chart in CHARTS.items():
        rows = chart_rows(spark, sf_dir, name).orderBy("position").collect()
        got = document[name]
        assert got["labels"] == [row[chart.label_name] for row in rows], name
        if chart.titled:
            assert [d["label"] for d in got["datasets"]] == [s.title for s in chart.series]
            lists = {s.name: d["data"] for s, d in zip(chart.series, got["datasets"])}
        else:
            lists = {s.name: got[s.name] for s in chart.series}
        for series in chart.series:
            assert lists[series.name] == [row[series.name] for row in rows], (name, series.name)
            kind = int if series.digits is None else float
            assert {type(value) for value in lists[series.name]} == {kind}, (name, series.name)


def test_document_keeps_the_first_countries_before_it_collects(spark):
    rows = [session(i, country=f"C{i:02d}") for i in range(17)] + [session(99, country="C16")]
    df = features.process("web_analytics", entity(spark, "web_analytics", rows))
    found = dashboard.payload(spark, {"web_analytics": aggregates.summarize("web_analytics", df)})
    document = json.loads(found.first().payload)
    assert document["web_by_country"]["labels"] == ["C16"] + [f"C{i:02d}" for i in range(14)]
    assert document["web_top_pages"] == {
        "labels": ["/"], "sessions": [18], "bounce_rate": document["web_top_pages"]["bounce_rate"],
        "conversion_rate": document["web_top_pages"]["conversion_rate"]}
    assert document["kpis"]["total_sessions"] == 18
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    table = aggregated(spark, "web_by_country", rows)
    single = json.loads(dashboard.chart_json(spark, CHARTS["web_by_country"], table).first().payload)
    assert single == document["web_by_country"]


def test_document_without_tables(spark):
    document = json.loads(dashboard.payload(spark, {}).first().payload)
    assert document["web_trend"] == {"labels": [], "datasets": []}
    assert document["web_by_country"] == {"labels": [], "data": []}
    assert set(document["kpis"].values()) == {0}


def test_document_of_some_tables(spark):
    df = features.process("deals", entity(spark, "deals", [deal(1), deal(2, region=None)]))
    document = json.loads(
        dashboard.payload(spark, {"deals": aggregates.summarize("deals", df)}).first().payload
    )
    assert document["deals_by_region"] == {
        "labels": ["Europe"], "revenue": [100.0], "win_rate": [0.0], "deal_count": [1],
    }
    assert document["kpis"]["total_deals"] == 2
    assert document["contacts_lifecycle"] == {"labels": [], "data": []}


def test_document_of_an_empty_table(spark):
    df = features.process("deals", entity(spark, "deals", []))
    document = json.loads(
        dashboard.payload(spark, {"deals": aggregates.summarize("deals", df)}).first().payload
    )
    assert document["deals_by_region"]["labels"] == []
    assert document["kpis"]["total_revenue"] == 0.0
    assert document["kpis"]["win_rate"] is None


def test_single_chart_as_json(spark):
    chart = CHARTS["revenue_trend"]
    table = aggregated(spark, chart.aggregate, [deal(1), deal(2, created_at=None)])
    got = json.loads(dashboard.chart_json(spark, chart, table).first().payload)
    assert got == {"labels": ["2023-04"], "datasets": [
        {"label": "Closed Revenue", "data": [100.0]},
        {"label": "Weighted Pipeline", "data": [50.0]},
    ]}
    absent = json.loads(dashboard.chart_json(spark, chart, None).first().payload)
    assert absent == {"labels": [], "datasets": []}
