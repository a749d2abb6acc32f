from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from cohortflow.operators import monitoring
from cohortflow.operators.monitoring import Alarm

START = datetime(2024, 3, 1)


def windows(spark, values):
    """One row per 5-minute period that has a value."""
    rows = [
        (START + timedelta(minutes=5 * i), "primary", float(v), int(v), int(v)) for i, v in enumerate(values) if v is not None
    ]
    schema = "period_start timestamp, variant_name string, avg_latency double, errors long, invocations long"
    return spark.createDataFrame(rows, schema).repartition(3)


def brute_force(values, alarm):
    states = []
    for i in range(len(values)):
        recent = values[max(0, i + 1 - alarm.periods) : i + 1]
        breaches = [
            alarm.missing_breaches if v is None else (v > alarm.threshold if alarm.above else v < alarm.threshold) for v in recent
        ]
        if len(recent) < alarm.periods:
            states.append("INSUFFICIENT_DATA")
        else:
            states.append("ALARM" if all(breaches) else "OK")
    return states


def states(spark, values, alarm, until=None):
    df = monitoring.evaluate_alarm(windows(spark, values), alarm, "5 minutes", until=until)
    return [r["state"] for r in sorted(df.collect(), key=lambda r: r["period_start"])]


@pytest.mark.parametrize("alarm", [
    Alarm("latency", "avg_latency", True, 5000, 2, False),
    Alarm("errors", "errors", True, 10, 2, False),
    Alarm("traffic", "invocations", False, 1, 6, True),
])
def test_states_equal_brute_force(spark, alarm):
    rng = random.Random(2)
    choices = [None, 0, alarm.threshold, alarm.threshold + 1]
    values = [1, *[rng.choice(choices) for _ in range(60)], *[None] * 8, *[rng.choice(choices) for _ in range(20)], 1]
    assert states(spark, values, alarm) == brute_force(values, alarm)


def test_threshold_itself_does_not_breach(spark):
    assert set(states(spark, [5000, 5000, 5000], monitoring.HIGH_LATENCY)) == {"INSUFFICIENT_DATA", "OK"}
    assert states(spark, [1] * 6, monitoring.LOW_INVOCATION)[-1] == "OK"


def test_silence_up_to_a_time(spark):
    until = (START + timedelta(minutes=5 * 8)).isoformat(sep=" ")
    found = states(spark, [1, 1], monitoring.LOW_INVOCATION, until)
    assert len(found) == 8
    assert found == brute_force([1, 1] + [None] * 6, monitoring.LOW_INVOCATION)


def test_variants_are_judged_apart(spark):
    one = windows(spark, [6000, 6000])
    other = windows(spark, [10, 10]).replace("primary", "shadow", "variant_name")
    rows = monitoring.evaluate_alarm(one.unionByName(other), monitoring.HIGH_LATENCY, "5 minutes").collect()
    assert {(r["variant_name"], r["state"]) for r in rows if r["state"] != "INSUFFICIENT_DATA"} == {
        ("primary", "ALARM"), ("shadow", "OK")
    }
