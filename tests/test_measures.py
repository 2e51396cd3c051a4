"""Aggregate measures: exact, order-free, null rules."""

import random
from fractions import Fraction

import pytest

from crmkiln.functions.measures import all_inputs, count, mean, named, rows, total


def measure(df, **measures):
    return df.selectExpr(*all_inputs(measures.values())).selectExpr(
        *named({alias: m.combine() for alias, m in measures.items()})
    ).first()


def doubles(spark, values, partitions=3):
    data = spark.sparkContext.parallelize([(v,) for v in values], partitions)
    return spark.createDataFrame(data, "x double")


def test_money_sum_is_exact_and_free_of_order(spark):
    rng = random.Random(1)
    values = [rng.randrange(1, 10**9) / 100 for _ in range(5000)]
    exact = float(sum(Fraction(round(v * 100), 100) for v in values))
    for partitions in (1, 4, 7):
        rng.shuffle(values)
        got = measure(doubles(spark, values, partitions), s=total("x", 2), m=mean("x", 2))
        assert got.s == exact
        assert got.m == exact / 5000


def test_values_with_more_decimals_lose_nothing(spark):
    got = measure(doubles(spark, [0.001, 0.002, 1 / 3]), s=total("x", 2))
    assert abs(got.s - (0.003 + 1 / 3)) < 1e-15


def test_very_large_and_infinite_values(spark):
    assert measure(doubles(spark, [1e15, 2.5]), s=total("x", 2)).s == 1e15 + 2.5
    assert measure(doubles(spark, [float("inf"), 2.5]), s=total("x", 2)).s == float("inf")


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, 4.5, 3), (None, 5.5, 4)],
                               "id long, x double, n long")
    got = measure(df, ids=count("id"), all=rows(), s=total("x", 1), m=mean("x", 1),
                  ns=total("n"), nm=mean("n"))
    assert tuple(got) == (2, 3, 10.0, 5.0, 7, 3.5)


def test_nothing_to_aggregate(spark):
    df = spark.createDataFrame([(None, None)], "x double, n long")
    got = measure(df, s=total("x", 2), m=mean("x", 2), ns=total("n"), nm=mean("n"))
    assert tuple(got) == (0.0, None, 0, None)


def test_restricted_sum(spark):
    df = spark.createDataFrame([(1, 2.5), (0, 4.0), (None, 8.0), (1, None)], "w long, x double")
    assert measure(df, s=total("x", 2, only="w")).s == 2.5


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_totals_beyond_any_long(spark, ansi):
    """Units beyond 1e19 and 1e21, in any order, with the arithmetic mode on and off."""
    rng = random.Random(2)
    values = [9e12 + k / 4 for k in range(20_000)] + [float(rng.randrange(10**13, 10**16)) for _ in range(500)]
    exact = float(sum(map(Fraction, values)))
    try:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        for partitions in (1, 3, 8):
            rng.shuffle(values)
            got = measure(doubles(spark, values, partitions), s=total("x", 2), m=mean("x", 2))
            assert (got.s, got.m) == (exact, exact / len(values))
        assert measure(doubles(spark, [1e16, 1e13 + 0.5, -1e16]), s=total("x", 2)).s == 1e13 + 0.5
        with pytest.raises(Exception, match="exceeds 9e21"):
            measure(doubles(spark, [8e21] * 4), s=total("x", 2))
        with pytest.raises(Exception, match="exceeds 9e21"):
            measure(doubles(spark, [1e25]), s=total("x", 2))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
