from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import ordering
from cohortflow.session import materialize


def frame(spark, values, partitions=5):
    rows = [(None if v is None else float(v),) for v in values]
    return spark.createDataFrame(rows, "x double").repartition(partitions)


RNG = np.random.default_rng(5)
SHAPES = {
    "uniform": RNG.random(3000),
    "heavy tail": np.exp(RNG.normal(0, 4, 3000)),
    # A third of the rows share one value, next to the wanted quantiles.
    "hot value": np.concatenate([RNG.random(2000), np.full(1000, 0.65)]),
    "two values": np.concatenate([np.zeros(2000), np.ones(1000)]),
    "constant": np.full(3000, 7.0),
    "few": np.array([3.0, 1.0]),
    "one": np.array([4.0]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("q", [0.0, 0.6, 0.7, 1.0])
def test_exact_quantile(spark, shape, q):
    values = SHAPES[shape]
    df = frame(spark, [*values, None, None])
    # Few bits make the search narrow many times; many resolve single values at once.
    for bits in [4, 12]:
        assert ordering.exact_quantile(df, "x", q, bits) == pytest.approx(np.quantile(values, q), abs=1e-12, rel=1e-12)


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1e-310, 1.0, 1.0000000000000002,
         0.9999999999999999, 2.0, 3.9999999999999996, 4.0, -4.0, -4.000000000000001, 1e300, 2.0**-1074 * 3, 2.0**1023, 2.0**-1022]


def test_sortable_keeps_the_order(spark):
    values = [*EDGES, *(2.0**e for e in range(-1070, 1023, 7)), *RNG.normal(0, 1e9, 300), float("inf"), float("-inf")]
    rows = frame(spark, values).select("x", ordering.sortable(F.col("x")).alias("k")).collect()
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert all(r["k"] == bits(r["x"]) for r in rows)


def test_every_rank_of_extreme_values(spark):
    values = [*EDGES, float("inf"), float("-inf"), float("inf")]
    df = frame(spark, [*values, None, float("nan")])
    assert [ordering.order_statistic(df, "x", r, 7) for r in range(0, len(values), 3)] == sorted(values)[::3]


def test_many_quantiles_in_the_same_passes(spark):
    """Ten million rows, two columns: few jobs, few rows at the driver, and the values of a sort."""
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"), "id")
    df = df.select((F.col("h") / (1 << 40)).alias("a"), F.when(F.col("id") % 3 == 0, 2.5).otherwise(F.exp(F.col("h") / (1 << 36))).alias("b"))
    df = materialize(df, "ten-million")
    collected = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "")
    original = ordering._counts
    ordering._counts = lambda *args: collected.append(original(*args)) or collected[-1]
    try:
        found = ordering.exact_quantiles(df, [("a", 0.7), ("b", 0.6), ("b", 0.1)])
    finally:
        ordering._counts = original
        jobs = len(tracker.getJobIdsForGroup("quantiles"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == pytest.approx(df.agg(F.percentile("a", 0.7), F.percentile("b", 0.6), F.percentile("b", 0.1)).first(), rel=1e-12)
    assert jobs <= 10
    assert max(sum(map(len, parts)) for parts in collected) <= 3 * (1 << ordering.LEVEL_BITS)


def test_quantile_of_nothing(spark):
    assert ordering.exact_quantile(frame(spark, [None]), "x", 0.5) is None


def test_order_statistic_rejects_bad_rank(spark):
    with pytest.raises(ValueError, match="rank"):
        ordering.order_statistic(frame(spark, [1.0]), "x", 1)


def test_running_totals(spark):
    values = RNG.permutation(2000)
    rows = [(int(v), int(v) % 7) for v in values]
    df = spark.createDataFrame(rows, "k long, w long").repartition(11)
    found = {r["k"]: (r["before"], r["place"]) for r in ordering.running_totals(
        df, ["k"], {"before": F.col("w"), "place": F.lit(1).cast("bigint")}
    ).collect()}
    total = 0
    for place, k in enumerate(sorted(values)):
        assert found[k] == (total, place)
        total += k % 7


def test_global_index_on_text(spark):
    names = [f"user_{n:05d}" for n in RNG.permutation(500)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(6)
    indexed = ordering.global_index(df, ["name"])
    assert {r["name"]: r["user_index"] for r in indexed.collect()} == {n: i for i, n in enumerate(sorted(names))}
    # Written rows with an offset added: no exchange, no join.
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_global_index_moves_wide_rows_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ordering, "materialize", lambda df, name: written.append(df) or materialize(df, name))
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit("wide").alias("text")).repartition(3)
    indexed = ordering.global_index(df, ["k"], "at")
    assert sorted(r["at"] for r in indexed.collect()) == list(range(1000))
    assert [r["k"] for r in indexed.orderBy("at").collect()] == sorted(i % 7 for i in range(1000))
    assert len(written) == 1 and written[0]._jdf.queryExecution().executedPlan().toString().count("rangepartitioning") == 1
    assert ordering.global_index(df.limit(0), ["k"], "at").count() == 0
