from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import validation
from cohortflow.operators.validation import InvalidInput

GOOD = {
    "age": 35.0, "session_count": 20.0, "avg_session_duration": 450.0, "page_views": 35.0, "purchase_history": 5.0,
    "total_spent": 250.0, "engagement_score": 0.75, "historical_conversion_rate": 0.4, "gender": "female", "location": "US",
}
SCHEMA = ", ".join(f"{name} {'string' if name in ('gender', 'location') else 'double'}" for name in GOOD)


def frame(spark, **changes):
    return spark.createDataFrame([tuple((GOOD | changes).values())], SCHEMA)


def test_good_request_passes(spark):
    assert validation.validate(frame(spark)).count() == 1


BOUNDS = [
    (name, bound, -1 if side == 0 else 1) for name, limits in validation.RANGES.items() for side, bound in enumerate(limits) if bound is not None
]


def test_every_bound(spark):
    """At a bound is fine, beyond it is not; one row per case, in one pass."""
    cases = []
    for name, bound, outward in BOUNDS:
        cases += [(GOOD | {name: float(bound)}, True), (GOOD | {name: bound + 0.001 * outward}, False)]
    rows = [(*case.values(), ok) for case, ok in cases]
    checked = validation.validate(spark.createDataFrame(rows, SCHEMA + ", expected boolean"), "quarantine")
    assert checked.where(F.col("is_valid") != F.col("expected")).count() == 0


@pytest.mark.parametrize(("name", "value"), [("age", 121.0), ("engagement_score", -0.01), ("location", None), ("gender", None)])
def test_one_bad_row_fails_the_batch(spark, name, value):
    df = frame(spark).unionByName(frame(spark, **{name: value}))
    with pytest.raises(InvalidInput, match=name):
        validation.validate(df)


@pytest.mark.parametrize("value", [None, float("nan")])
def test_missing_numbers_break_no_rule(spark, value):
    assert validation.validate(frame(spark, age=value, engagement_score=value)).count() == 1


def test_columns_and_types(spark):
    with pytest.raises(InvalidInput, match="location"):
        validation.validate(frame(spark).drop("location"))
    with pytest.raises(InvalidInput, match="age"):
        validation.validate(frame(spark).withColumn("age", F.lit("35")))
    with pytest.raises(InvalidInput, match="gender"):
        validation.validate(frame(spark).withColumn("gender", F.lit(1)))
    with pytest.raises(ValueError, match="mode"):
        validation.validate(frame(spark), "other")


def test_report_counts_every_rule(spark):
    df = frame(spark, age=-1.0).unionByName(frame(spark, age=121.0, total_spent=-5.0))
    report = {(r["column"], r["rule"]): r["n_bad"] for r in validation.validate(df, "report").collect()}
    assert report[("age", "minimum")] == report[("age", "maximum")] == report[("total_spent", "minimum")] == 1
    assert sum(report.values()) == 3 and len(report) == len(validation.rules())


def test_unknown_values_only_warn(spark):
    df = frame(spark, gender="x").unionByName(frame(spark, gender="x")).unionByName(frame(spark))
    assert [tuple(r) for r in validation.unknown_values(df).collect()] == [("x", 2)]


def test_spelling_map(spark):
    df = spark.createDataFrame([("male",), ("O",), ("M",), ("x",), (None,)], "gender string")
    assert [r[0] for r in validation.normalise_gender(df).collect()] == ["M", "Other", "M", "x", None]


def test_rules_are_counted_by_the_job_itself(spark, tmp_path):
    rows = spark.createDataFrame([tuple(GOOD.values()), tuple((GOOD | {"age": 200.0}).values())], SCHEMA)
    counted, check = validation.observed(rows)
    counted.write.parquet(str(tmp_path / "all"))
    with pytest.raises(InvalidInput, match="age.*maximum.*1 rows"):
        check()
    counted, check = validation.observed(rows.where("age < 100"))
    counted.write.parquet(str(tmp_path / "good"))
    check()
    with pytest.raises(InvalidInput):
        validation.observed(rows.drop("age"))
