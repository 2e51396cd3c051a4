"""The seven CRM entities as views over the TPC-H-like test tables.

Each view is integer arithmetic over one large table. Attributes that live in another table
(region, industry, country) come from left joins on the primary key of that table, so a fact row
is never lost; ``columns`` names what the caller reads. A lookup nobody reads is not joined, and its
attributes are then no columns of the view.
The joins are chained on the fact side, so that each lookup side is a plain scan: Spark broadcasts
it where its files are below the threshold, else shuffles both sides and splits hot keys (AQE skew
join).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from crmkiln import labels
from crmkiln.functions.columns import flag, pick, round_scaled

Reader = Callable[[str], DataFrame]
Columns = Iterable[str] | None

_START = "TIMESTAMP_NTZ '2023-01-01 00:00:00'"


# Columns the views read. With the schema given, declaring a scan opens no file. Narrower integers
# in the files widen to bigint.
_TABLES = {
    "region": "r_regionkey BIGINT, r_name STRING",
    "nation": "n_nationkey BIGINT, n_name STRING, n_regionkey BIGINT",
    "customer": "c_custkey BIGINT, c_nationkey BIGINT, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey BIGINT, s_acctbal DOUBLE",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber BIGINT,
        l_quantity DOUBLE, l_discount DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def reader(spark: SparkSession, directory: str) -> Reader:
    return lambda name: spark.read.schema(_TABLES[name]).parquet(
        f"{directory.rstrip('/')}/{name}.parquet"
    )


def _reads(columns: Columns, *supplied: str) -> bool:
    return columns is None or not set(supplied).isdisjoint(columns)


def _view(
    base: DataFrame, *expressions: str, joined: dict[str, tuple[str, str]]
) -> DataFrame:
    """The expressions, and the ``joined`` attributes (name -> expression, lookup column it needs)
    whose lookup is there."""
    found = {name: value for name, (value, column) in joined.items() if column in base.columns}
    return base.selectExpr(*expressions, *[f"{value} AS {name}" for name, value in found.items()])


def _with_region(base: DataFrame, read: Reader, nation_key: str, wanted: bool) -> DataFrame:
    """Add ``region`` by way of the nation."""
    if not wanted:
        return base
    nation = read("nation").selectExpr(f"n_nationkey AS {nation_key}", "n_regionkey")
    region = read("region").selectExpr("r_regionkey AS n_regionkey", "r_name AS region")
    return base.join(nation, nation_key, "left").join(region, "n_regionkey", "left")


def companies(read: Reader, columns: Columns = None) -> DataFrame:
    base = _with_region(read("supplier"), read, "s_nationkey", _reads(columns, "region"))
    return _view(
        base,
        "s_suppkey AS company_id",
        "s_name AS company_name",
        f"{pick(labels.INDUSTRIES, 's_suppkey % 20')} AS industry",
        """get(array(0, 7, 30, 120, 600, 3000, 20000), CAST(s_suppkey % 7 AS INT)) + s_suppkey % 3
            AS employee_count""",
        f"{round_scaled('s_acctbal * 1000', 2)} AS annual_revenue",
        "1950 + s_suppkey % 74 AS founded_year",
        "100 + s_suppkey * 104729 % 4999900 AS website_traffic_monthly",
        f"{_START} + s_suppkey % 1095 * INTERVAL '1' DAY AS created_at",
        joined={"region": ("region", "region")},
    )


def contacts(read: Reader, columns: Columns = None) -> DataFrame:
    base = _with_region(read("customer"), read, "c_nationkey", _reads(columns, "region"))
    return _view(
        base,
        "c_custkey AS contact_id",
        "concat(c_custkey, '@example.com') AS email",
        "c_custkey % 100 AS company_id",
        "c_mktsegment AS job_title",
        f"{pick(labels.LEAD_SOURCES, 'c_custkey * 3 % 10')} AS lead_source",
        "c_custkey * 37 % 101 AS lead_score",
        f"{pick(labels.LIFECYCLE_STAGES, 'c_custkey % 7')} AS lifecycle_stage",
        f"{_START} + c_custkey % 1095 * INTERVAL '1' DAY AS first_touch_date",
        "c_custkey * 31 % 1500 AS num_page_views",
        "c_custkey * 17 % 20 AS num_form_submissions",
        joined={"region": ("region", "region")},
    )


def deals(read: Reader, columns: Columns = None) -> DataFrame:
    base = read("orders")
    if _reads(columns, "industry", "region"):
        home = read("customer").selectExpr("c_custkey AS o_custkey", "c_nationkey")
        base = base.join(home, "o_custkey", "left")
    base = _with_region(base, read, "c_nationkey", _reads(columns, "region"))
    return _view(
        base,
        "o_orderkey AS deal_id",
        "o_custkey AS contact_id",
        "o_custkey % 100 AS company_id",
        "o_orderpriority AS deal_name",
        f"""CASE o_orderkey % 5
            WHEN 0 THEN CAST(floor(o_totalprice / 1000) AS DOUBLE)
            WHEN 1 THEN CAST(floor(o_totalprice / 100) AS DOUBLE)
            WHEN 2 THEN CAST(floor(o_totalprice / 10) AS DOUBLE)
            WHEN 3 THEN o_totalprice
            ELSE {round_scaled('o_totalprice * 5', 2)} END AS amount""",
        f"{pick(labels.DEAL_STAGES, 'o_orderkey % 6')} AS stage",
        f"{pick(labels.PIPELINES, 'o_custkey % 4')} AS pipeline",
        "CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 10 AS probability",
        "1 + o_orderkey * 13 % 364 AS days_in_pipeline",
        "o_orderdate AS created_at",
        joined={
            "industry": (pick(labels.INDUSTRIES, "c_nationkey % 20"), "c_nationkey"),
            "region": ("region", "region"),
        },
    )


def marketing_events(read: Reader, columns: Columns = None) -> DataFrame:
    return read("events").selectExpr(
        "event_id",
        "user_id AS contact_id",
        "event_type",
        f"{pick(labels.CHANNELS, 'user_id % 6')} AS channel",
        "event_id % 5000 + 1 AS campaign_id",
        "event_type AS utm_source",
        f"{pick(labels.DEVICES, 'event_id % 3')} AS device_type",
        "1 + floor(value * 3) AS session_duration_sec",
        "1 + event_id % 19 AS page_depth",
        "ts + make_ym_interval(0, CAST(user_id % 24 AS INT)) AS `timestamp`",
    )


def email_campaigns(read: Reader, columns: Columns = None) -> DataFrame:
    return read("lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS email_event_id",
        "l_orderkey % 1000 AS contact_id",
        "l_partkey % 5000 + 1 AS campaign_id",
        f"{pick(labels.CAMPAIGN_TYPES, 'l_partkey % 10')} AS campaign_type",
        f"{pick(labels.EMAIL_ACTIONS, '(l_orderkey + l_linenumber * 3) % 7')} AS action",
        "l_suppkey % 100 + 20 AS subject_line_length",
        "(l_orderkey * 5 + l_linenumber) % 24 AS send_hour",
        "l_orderkey % 7 AS send_day_of_week",
        "l_shipdate AS `timestamp`",
    )


def support_tickets(read: Reader, columns: Columns = None) -> DataFrame:
    return read("orders").selectExpr(
        "o_orderkey AS ticket_id",
        "o_custkey AS contact_id",
        "o_custkey % 100 AS company_id",
        f"{pick(labels.TICKET_CATEGORIES, 'o_orderkey % 10')} AS category",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
            WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low'
            ELSE 'Unspecified' END AS priority""",
        "o_orderstatus AS status",
        """CAST(o_orderkey * 29 % CASE o_orderpriority WHEN '1-URGENT' THEN 100 ELSE 4000 END
            AS DOUBLE) / 10 AS resolution_hours""",
        "1 + (o_orderkey * 3 + o_custkey) % 5 AS satisfaction_score",
        "o_orderkey % 29 + 1 AS num_interactions",
        "o_orderdate AS created_at",
    )


def web_analytics(read: Reader, columns: Columns = None) -> DataFrame:
    base = read("lineitem")
    if _reads(columns, "country"):
        origin = read("supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey")
        nation = read("nation").selectExpr("n_nationkey AS s_nationkey", "n_name AS country")
        base = base.join(origin, "l_suppkey", "left").join(nation, "s_nationkey", "left")
    return _view(
        base,
        "l_orderkey * 10 + l_linenumber AS session_id",
        f"{pick(labels.PAGES, 'l_partkey % 20')} AS page_url",
        "l_linestatus AS referrer_domain",
        "l_returnflag AS browser",
        f"{pick(labels.DEVICES, 'l_suppkey % 3')} AS device_type",
        "1 + l_partkey * l_linenumber % 600 AS session_duration_sec",
        "1 + CAST(l_quantity AS BIGINT) % 24 AS page_views",
        f"{flag("l_returnflag = 'R'")} AS bounce",
        f"{flag('l_discount >= 0.095D')} AS conversion",
        "l_shipdate + l_orderkey % 24 * INTERVAL '1' HOUR AS `timestamp`",
        joined={"country": ("country", "country")},
    )


VIEWS = {
    "companies": companies,
    "contacts": contacts,
    "deals": deals,
    "marketing_events": marketing_events,
    "email_campaigns": email_campaigns,
    "support_tickets": support_tickets,
    "web_analytics": web_analytics,
}


def entity(spark: SparkSession, directory: str, name: str, columns: Columns = None) -> DataFrame:
    """A raw entity over the tables in ``directory``; ``columns`` limits the lookups joined."""
    return VIEWS[name](reader(spark, directory), columns)
