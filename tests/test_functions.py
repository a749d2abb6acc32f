from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortflow.functions import behaviour, draws, history, numeric

QUICK = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("5", 5.0), ("5.", 5.0), (".5", 0.5), ("1e5", 1e5), ("-2.5E-3", -0.0025), ("+3", 3.0), (" 7 ", 7.0),
        ("1e", None), ("5d", None), ("5f", None), ("0x1p3", None), ("0X1P3", None), ("NaN", None), ("Infinity", None),
        ("n/a", None), ("", None), ("1_000", None), (".", None), ("e5", None), (None, None),
    ],
)
def test_parse_number(spark, text, number):
    assert values(spark, [(text,)], "s string", numeric.parse_number(F.col("s"))) == [(number,)]


def test_missing_values_stay_missing(spark):
    rows = [(None,), (-5.0,), (0.5,), (200.0,)]
    found = values(spark, rows, "x double", numeric.clip(F.col("x"), 0, 100), numeric.at_least(F.col("x"), 1))
    assert found == [(None, None), (0.0, 1.0), (0.5, 1.0), (100.0, 200.0)]


def test_nulls_for_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1, "a"), (2.0, 2, None)], "x double, n int, s string")
    assert [tuple(r) for r in numeric.nulls_for_nan(df).collect()] == [(None, 1, "a"), (2.0, 2, None)]


def test_safe_ratio_and_truncate(spark):
    rows = [(1, 0, -3.7), (1, 4, 3.7)]
    columns = [numeric.safe_ratio(F.col("a"), F.col("b")), numeric.truncate(F.col("c"))]
    assert values(spark, rows, "a int, b int, c double", *columns) == [(0.0, -3), (0.25, 3)]


def test_bin_edges(spark):
    ages = [(a,) for a in [-1, 0, 1, 25, 26, 35, 36, 50, 51, 100, 101, None]]
    young = [None, None, "young", "young", "adult", "adult", "middle_aged", "middle_aged", "senior", "senior", None, None]
    assert [r[0] for r in values(spark, ages, "age int", behaviour.age_group())] == young
    spends = [(s,) for s in [-2.0, -1.0, -0.5, 0.0, 0.01, 50.0, 50.5, 200.0, 200.5, 1e9, None]]
    tiers = [None, None, "none", "none", "low", "low", "medium", "medium", "high", "high", None]
    assert [r[0] for r in values(spark, spends, "total_spent double", behaviour.spending_tier())] == tiers


def test_ratios(spark):
    rows = [(10.0, 0, 7, 0), (10.0, 4, 7, 2), (10.0, None, 7, None), (None, 2, None, 3)]
    found = values(
        spark, rows, "total_spent double, purchase_history long, page_views long, session_count long",
        behaviour.spend_per_purchase(), behaviour.session_efficiency(),
    )
    assert found == [(0.0, 7.0), (2.5, 3.5), (0.0, None), (None, None)]


entries = st.lists(
    st.tuples(st.integers(1, 10).map(lambda n: f"exp_{n}"), st.sampled_from("ABC"), st.booleans()), max_size=6
)


@QUICK
@given(st.lists(entries, min_size=1, max_size=8))
def test_history_roundtrip(spark, histories):
    rows = [([{"experiment": e, "variant": v, "converted": c} for e, v, c in h],) for h in histories]
    df = spark.createDataFrame(rows, f"h {history.HISTORY_TYPE}").select(
        "h", history.format_history(F.col("h")).alias("text"), history.conversion_rate(F.col("h")).alias("rate")
    )
    for row, expected in zip(df.select("*", history.parse_history(F.col("text")).alias("parsed")).collect(), histories):
        assert row["text"] == "|".join(f"{e}:{v}:{c}" for e, v, c in expected)
        assert row["parsed"] == row["h"]
        assert row["rate"] == pytest.approx(sum(c for _, _, c in expected) / len(expected) if expected else 0.0)


def test_missing_history_is_empty(spark):
    found = values(spark, [(None,), ("",)], "t string", history.parse_history(F.col("t")))
    assert found == [([],), ([],)]


def test_draws_do_not_depend_on_partitioning(spark):
    def drawn(partitions):
        df = spark.range(0, 500, 1, partitions).select("id", draws.uniform(F.col("id"), 1, 5).alias("u"))
        return sorted(tuple(r) for r in df.collect())

    first = drawn(1)
    assert first == drawn(7)
    assert all(0 <= u < 1 for _, u in first)


@pytest.mark.parametrize("rate", [1, 3, 15, 25])
def test_poisson_mean_and_variance(spark, rate):
    df = spark.range(20_000).select(draws.poisson(draws.uniform(F.col("id"), 7, 0), rate).alias("x"))
    mean, variance = df.agg(F.avg("x"), F.var_pop("x")).first()
    assert mean == pytest.approx(rate, rel=0.05)
    assert variance == pytest.approx(rate, rel=0.08)


def test_continuous_draws(spark):
    u = [draws.uniform(F.col("id"), 3, i) for i in range(4)]
    row = spark.range(20_000).select(
        draws.normal(u[0], u[1], 35, 12).alias("n"), draws.exponential(u[2], 300).alias("e"), draws.beta_2_3(u).alias("b")
    ).agg(F.avg("n"), F.stddev_pop("n"), F.avg("e"), F.avg("b")).first()
    assert row[0] == pytest.approx(35, abs=0.5)
    assert row[1] == pytest.approx(12, rel=0.05)
    assert row[2] == pytest.approx(300, rel=0.05)
    assert row[3] == pytest.approx(0.4, abs=0.01)


def test_choice_and_integer(spark):
    u = F.col("u")
    rows = [(0.0,), (0.4799,), (0.48,), (0.9599,), (0.96,), (0.999,)]
    found = values(spark, rows, "u double", draws.choice(u, [("M", 0.48), ("F", 0.48), ("Other", 0.04)]), draws.integer(u, 1, 10))
    assert [r[0] for r in found] == ["M", "M", "F", "F", "Other", "Other"]
    assert [r[1] for r in found] == [1, 5, 5, 10, 10, 10]


def test_poisson_cdf_is_a_distribution():
    for rate in [1, 2, 10, 25]:
        steps = draws.poisson_cdf(rate)
        assert all(np.diff(steps) >= 0) and 1 - steps[-1] <= 2**-32
        assert math.isclose(steps[0], math.exp(-rate))
