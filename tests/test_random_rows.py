"""Random entity rows with nulls, extreme values and hot keys, against the SQL answers."""

import datetime as dt
import random

import duckdb
import pytest

from compare import oracle_table, spark_table
from crmkiln import labels, schemas
from crmkiln.operators import aggregates, features
from crmkiln.operators.aggregates import AGGREGATES
from fixtures import entity
from oracle.entities import FEATURES
from oracle.queries import grouped

_TEXTS = {
    "stage": labels.DEAL_STAGES + ["Other"], "action": labels.EMAIL_ACTIONS + ["sent"],
    "priority": labels.TICKET_PRIORITIES + ["Unspecified"], "region": ["Europe", "Africa"],
}
_WHOLE = {
    "employee_count": [0, 1, 10, 11, 5000, 5001], "lead_score": [-1, 0, 20, 21, 100, 101],
    "num_page_views": [0, 400, 1001], "days_in_pipeline": [-3, 0, 1, 300],
    "session_duration_sec": [29, 30, 31, 60, 61], "bounce": [0, 1], "conversion": [0, 1],
    "send_hour": list(range(24)),
}
_DECIMALS = {"probability": 1, "resolution_hours": 1}


def value(rng, field):
    if rng.random() < 0.08:
        return None
    kind = field.dataType.simpleString()
    if kind == "string":
        choices = _TEXTS.get(field.name, ["a", "b", "c"])
        # a third of the rows share one label
        return choices[0] if rng.random() < 1 / 3 else rng.choice(choices)
    if kind == "bigint":
        return rng.choice(_WHOLE[field.name]) if field.name in _WHOLE else rng.randrange(1, 2000)
    if kind == "double":
        decimals = _DECIMALS.get(field.name, 2)
        if field.name == "resolution_hours":
            return rng.choice([4.0, 4.1, 24.0, 72.0, 168.0, 168.1, rng.randrange(7200) / 10])
        if field.name == "probability":
            return rng.randrange(0, 1001) / 10
        bound = rng.choice([10**3, 10**6, 10**9, 10**11])
        return rng.randrange(-bound // 10, bound) / 10**decimals
    return dt.datetime(2023, 1, 1) + dt.timedelta(seconds=rng.randrange(3 * 365 * 86400))


@pytest.mark.parametrize("name", schemas.ENTITIES)
def test_random_rows(spark, tmp_path, name):
    rng = random.Random(name)
    fields = schemas.RAW[name].fields
    rows = [{field.name: value(rng, field) for field in fields} for _ in range(1500)]
    path = str(tmp_path / "rows")
    entity(spark, name, rows).repartition(5).write.parquet(path)

    connection = duckdb.connect()
    connection.execute(
        f"CREATE VIEW {name} AS SELECT r.*, {FEATURES[name]} FROM read_parquet('{path}/*.parquet') r")
    done = features.process(name, spark.read.parquet(path))
    assert spark_table(done) == oracle_table(connection, f"SELECT * FROM {name}")

    summary = aggregates.summarize(name, done)
    for spec in aggregates.of_source(name):
        expected = oracle_table(connection, grouped(spec.name))
        assert spark_table(aggregates.aggregate(AGGREGATES[spec.name], done)) == expected, spec.name
        assert spark_table(aggregates.from_summary(spec, summary)) == expected, spec.name
