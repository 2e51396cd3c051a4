"""Physical plans: what is read, shuffled, broadcast and where Python would run."""

import re

import pytest

from compare import connect, oracle_table, spark_table
from crmkiln.plans import queries
from crmkiln.plans.queries import registry
import __spark_entry__ as entry

QUERIES = {name: query for name, query in registry().items() if not name.startswith("layer_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    return [set(re.findall(r"(\w+):", schema)) for schema in schemas]


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_pair_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_scans_read_only_what_the_query_uses(spark, sf_dir):
    text = plan(QUERIES["agg_email_by_hour"](spark, sf_dir))
    assert read_columns(text) == [{"l_orderkey", "l_linenumber"}]
    text = plan(QUERIES["agg_revenue_by_month"](spark, sf_dir))
    assert read_columns(text) == [{"o_orderkey", "o_totalprice", "o_orderdate"}]
    assert "PushedFilters: [IsNotNull(o_orderdate)]" in text


@pytest.mark.parametrize("name, joins", [
    ("agg_revenue_by_quarter", 0), ("agg_deals_by_industry", 1), ("agg_deals_by_region", 3),
    ("agg_web_by_device", 0), ("agg_web_by_country", 2), ("agg_contacts_by_source", 0),
    ("agg_companies_by_industry", 0), ("kpi_summary", 0),
])
def test_only_wanted_lookups_are_joined(spark, sf_dir, name, joins):
    assert len(re.findall(r"Join \[", plan(QUERIES[name](spark, sf_dir)))) == joins


def test_aggregates_combine_before_one_exchange(spark, sf_dir):
    for name in ("agg_pipeline_stages", "agg_web_by_page", "agg_marketing_by_month"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.count("Exchange") == 1
        assert text.index("Exchange hashpartitioning") < text.index("partial_")
        assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_one_scan_per_entity_in_the_document(spark, sf_dir):
    text = plan(QUERIES["dashboard_payload"](spark, sf_dir))
    # seven fact scans and the lookups of companies, deals and web sessions
    assert text.count("FileScan parquet") == 7 + 2 + 3 + 2
    assert text.count("Expand") == 7


def test_quality_scans_each_entity_once_and_computes_no_aggregate(spark, sf_dir):
    text = plan(QUERIES["quality_checks"](spark, sf_dir))
    assert text.count("FileScan parquet") == 7 + 2 + 3 + 2
    assert "Expand" not in text and "hashpartitioning(grouping" not in text


def test_top_k_is_kept_per_task(spark, sf_dir):
    for name in ("chart_web_by_country", "top_industries"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_small_lookups_are_broadcast_by_their_size(spark, sf_dir):
    text = plan(QUERIES["agg_deals_by_region"](spark, sf_dir))
    assert text.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in text


@pytest.fixture
def large_lookups(spark):
    """Settings under which every lookup counts as large and a modest partition as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def skewed_tables(spark, sf_dir, folder):
    """The test tables with a third of all orders and lines on one customer and one supplier, some
    of them without a match."""
    for name in ("region", "nation", "customer", "supplier"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "explode(sequence(0, 9)) AS copy", "*")
    orders.selectExpr(
        "o_orderkey + copy * 100000 AS o_orderkey",
        "CASE WHEN o_orderkey % 3 = 0 THEN 7 WHEN o_orderkey % 50 = 1 THEN 999999"
        " WHEN o_orderkey % 50 = 2 THEN NULL ELSE o_custkey END AS o_custkey",
        "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    ).repartition(8).write.parquet(f"{folder}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.selectExpr(
        "l_orderkey", "l_partkey", "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey",
        "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate",
    ).repartition(8).write.parquet(f"{folder}/lineitem.parquet")


def test_hot_keys_are_split_and_results_whole(spark, sf_dir, tmp_path, large_lookups):
    folder = str(tmp_path)
    skewed_tables(spark, sf_dir, folder)
    connection = connect_folders(folder)
    oracle = entry.oracle_sql()
    for name in ("agg_deals_by_region", "agg_deals_by_industry", "agg_web_by_country"):
        df = registry()[name](spark, folder)
        assert spark_table(df) == oracle_table(connection, oracle[name]), name
        final = plan(df)
        assert "SortMergeJoin" in final
        assert "skew=true" in final, name
    total = queries.aggregated(spark, folder, "pipeline_stages").agg({"count": "sum"}).first()[0]
    assert total == spark.read.parquet(f"{folder}/orders.parquet").count()


def connect_folders(folder):
    connection = connect("/nonexistent")
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return connection
