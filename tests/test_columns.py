"""Row-wise expressions at their boundaries."""

import math
import random

import numpy as np
import pytest

from crmkiln import labels
from crmkiln.functions import columns as c


def evaluate(spark, kind, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [row.y for row in df.selectExpr("i", f"{expression} AS y").orderBy("i").collect()]


def test_revenue_bins_are_closed_above(spark):
    values = [-1.0, 0.0, 0.01, 1000.0, 1000.01, 10000.0, 50000.0, 200000.0, 1e6, 1000000.01, None]
    bins = c.cut("x", labels.REVENUE_EDGES, labels.REVENUE_LABELS)
    assert evaluate(spark, "double", values, bins) == [
        None, None, "< $1K", "< $1K", "$1K–10K", "$1K–10K", "$10K–50K", "$50K–200K",
        "$200K–1M", "> $1M", None,
    ]


def test_employee_bins(spark):
    values = [0, 1, 10, 11, 50, 51, 200, 201, 1000, 1001, 5000, 5001, None]
    bins = c.cut("x", labels.EMPLOYEE_EDGES, labels.EMPLOYEE_LABELS)
    assert evaluate(spark, "long", values, bins) == [
        None, "Micro", "Micro", "Small", "Small", "Medium", "Medium", "Large", "Large",
        "Enterprise", "Enterprise", "Mega", None,
    ]


def test_grade_bins(spark):
    values = [-1, 0, 20, 21, 40, 41, 60, 61, 80, 81, 100, 101, None]
    bins = c.cut("x", labels.GRADE_EDGES, labels.GRADE_LABELS)
    assert evaluate(spark, "long", values, bins) == [
        None, "F", "F", "D", "D", "C", "C", "B", "B", "A", "A", None, None,
    ]


def test_flag_of_unknown_is_zero(spark):
    assert evaluate(spark, "string", ["a", "b", None], c.flag("x = 'a'")) == [1, 0, 0]


def test_clips_keep_null(spark):
    assert evaluate(spark, "long", [-5, 0, 1, 7, None], c.at_least("x", 1)) == [1, 1, 1, 7, None]
    assert evaluate(spark, "long", [999, 1000, 1001, None], c.at_most("x", 1000)) == [
        999, 1000, 1000, None,
    ]


def test_scaled_rounding_goes_to_even(spark):
    assert evaluate(spark, "double", [0.125, 2.675, 1.005, None], c.round_scaled("x", 2)) == [
        0.12, 2.68, 1.0, None,
    ]


def test_scaled_rounding_equals_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(9, 2, 3000), -rng.lognormal(3, 2, 500)])
    values = np.concatenate([values, np.arange(1, 800) / 8, np.arange(1, 800) / 1000])
    for digits in (2, 4):
        got = evaluate(spark, "double", values.tolist(), c.round_scaled("x", digits))
        assert got == np.round(values, digits).tolist()


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_exact_rounding_equals_decimal_rounding_of_the_binary_value(spark, digits):
    rng = random.Random(5)
    values = [3.14159, 2.5, 2.675, 1.005, 0.125, 0.375, 62.5, 6.25, 0.05, 0.15, 0.25, -2.675, 0.0]
    values += [n / 1000 + rng.choice([0, 0.0005]) for n in range(2000)]
    values += [rng.randrange(10**9) / 200 for _ in range(2000)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(1000)]
    values += [rng.uniform(1e12, 1e17) for _ in range(500)]
    values += [math.nextafter(n / 20, side) for n in range(1, 400) for side in (0.0, 1e9)]
    got = evaluate(spark, "double", values, c.round_exact("x", digits))
    assert got == [round(value, digits) if digits else float(round(value)) for value in values]
    assert evaluate(spark, "double", [None], c.round_exact("x", digits)) == [None]


def test_calendar_labels(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2023-04-01 13:00:00', "
                   "TIMESTAMP_NTZ '2024-12-31 23:59:59', CAST(NULL AS TIMESTAMP_NTZ))) AS t")
    rows = df.selectExpr(
        f"{c.quarter_label('t')} AS q", f"{c.month_label('t')} AS m", "hour(t) AS h",
        f"{c.weekday_label('t')} AS d",
    ).collect()
    assert [tuple(row) for row in rows] == [
        ("2023Q2", "2023-04", 13, "Saturday"), ("2024Q4", "2024-12", 23, "Tuesday"),
        (None, None, None, None),
    ]


def test_ordinal_puts_unknown_labels_last(spark):
    got = evaluate(spark, "string", ["Low", "Critical", "Other", None],
                   c.ordinal("x", labels.TICKET_PRIORITIES))
    assert got == [4, 1, 5, 5]


def test_hour_label(spark):
    assert evaluate(spark, "long", [0, 7, 23], c.hour_label("x")) == ["00:00", "07:00", "23:00"]


def test_text_literals_are_escaped(spark):
    value = "it's a \\ \"test\" – ü"
    assert spark.sql(f"SELECT {c.text(value)} AS v").first().v == value
