from __future__ import annotations

import random
import shutil
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import monitoring
from cohortflow.streaming import alarms

START, STEP = datetime(2024, 6, 1), timedelta(minutes=5)
DIMS = ["endpoint_name", "variant_name"]
SCHEMA = "period_start timestamp, endpoint_name string, variant_name string, avg_latency double, errors long, invocations long"
ALARMS = [monitoring.LOW_INVOCATION, monitoring.HIGH_ERROR_RATE, monitoring.Alarm("one", "avg_latency", True, 5000, 1, False)]


def closed_windows(seed):
    """Batches of closed windows, each later than the one before, with gaps, silent dimensions and empty batches."""
    rng = random.Random(seed)
    batches = []
    for low, high in [(0, 7), (7, 8), (8, 8), (8, 60), (60, 61), (90, 130)]:
        rows = []
        for endpoint, variant in [("e", "A"), ("e", "B"), (None, "A")]:
            if variant == "B" and 8 <= low < 90:
                continue
            rows += [
                (START + i * STEP, endpoint, variant, float(rng.choice([0, 6000])), rng.choice([0, 11, 20]), rng.choice([0, 1, 4]))
                for i in range(low, high) if rng.random() < 0.6
            ]
        batches.append(rows)
    return batches


def as_rows(df):
    return Counter((r["period_start"], *(r[d] for d in DIMS), None if r["value"] is None else float(r["value"]), r["state"]) for r in df.collect())


@pytest.mark.parametrize("alarm", ALARMS, ids=lambda a: a.name)
def test_batches_and_replays_equal_the_whole(spark, tmp_path, alarm):
    log = alarms.AlarmLog(str(tmp_path / "log"), alarm, dims=DIMS)
    everything = []
    for number, rows in enumerate(closed_windows(3)):
        everything += rows
        frame = spark.createDataFrame(rows, SCHEMA)
        log.add(frame, number)
        if number == 3:
            # Neither the windows nor the states of earlier batches are read again.
            for kind in ("windows", "states"):
                shutil.rmtree(tmp_path / "log" / kind / "batch=0")
                shutil.move(tmp_path / "log" / kind / "batch=1", tmp_path / f"{kind}-1")
        if number in (1, 4):
            log.add(frame, number)
    for kind in ("windows", "states"):
        shutil.move(tmp_path / f"{kind}-1", tmp_path / "log" / kind / "batch=1")
    whole = monitoring.evaluate_alarm(spark.createDataFrame(everything, SCHEMA), alarm, "5 minutes", DIMS)
    first = spark.createDataFrame(closed_windows(3)[0], SCHEMA)
    rest = as_rows(whole) - as_rows(monitoring.evaluate_alarm(first, alarm, "5 minutes", DIMS))
    assert as_rows(log.states(spark)) == rest
    tails = sorted(p.name for p in (tmp_path / "log" / "tail").iterdir())
    assert tails == ["batch=4", "batch=5"]
    kept = spark.read.parquet(str(tmp_path / "log" / "tail" / "batch=5")).groupBy(*DIMS).count().collect()
    assert all(r["count"] <= max(alarm.periods - 1, 1) for r in kept)


def test_windows_behind_the_tail_are_set_aside(spark, tmp_path):
    log = alarms.AlarmLog(str(tmp_path), monitoring.HIGH_ERROR_RATE, dims=DIMS)
    row = lambda i: (START + i * STEP, "e", "A", 1.0, 0, 1)
    log.add(spark.createDataFrame([row(0), row(4)], SCHEMA), 0)
    log.add(spark.createDataFrame([row(2), row(5)], SCHEMA), 1)
    assert log.states(spark).count() == 6
    late = spark.read.parquet(str(tmp_path / "late")).collect()
    assert [r["period_start"] for r in late] == [START + 2 * STEP]


def points(spark, minutes):
    rows = [(START + timedelta(minutes=m), "primary", 1.0, 0) for m in minutes]
    return spark.createDataFrame(rows, "ts timestamp, variant_name string, latency double, err4xx int")


def test_silence_at_the_end_is_reported(spark, tmp_path):
    """Events stop after an hour; only the clock goes on."""
    log = alarms.AlarmLog(str(tmp_path / "log"), monitoring.LOW_INVOCATION)
    clock = lambda minutes: points(spark, minutes).select("ts")
    folders = [str(tmp_path / n) for n in ("points", "beats")]

    def run():
        streams = [spark.readStream.schema(s).parquet(f) for s, f in zip((points(spark, [0]).schema, clock([0]).schema), folders)]
        alarms.watch(log, alarms.with_heartbeat(*streams), str(tmp_path / "checkpoint")).awaitTermination()

    points(spark, range(60)).write.parquet(folders[0])
    clock(range(60)).write.parquet(folders[1])
    run()
    assert log.states(spark).where("state = 'ALARM'").count() == 0
    clock(range(60, 181)).write.mode("append").parquet(folders[1])
    run()
    states = log.states(spark)
    alarmed = [r["period_start"] for r in states.where("state = 'ALARM'").orderBy("period_start").collect()]
    # The sixth silent period is the first alarm; periods up to ten minutes before the last beat are closed.
    assert alarmed == [START + timedelta(minutes=m) for m in range(85, 170, 5)]
    assert states.groupBy("period_start").count().where("count > 1").count() == 0
    run()
    assert as_plain(log.states(spark)) == as_plain(states)


def as_plain(df):
    return Counter(map(tuple, df.collect()))


def test_heartbeat_is_a_clock(spark):
    beats = alarms.heartbeat(spark, 5)
    assert beats.isStreaming and beats.columns == ["ts"]
    joined = alarms.with_heartbeat(points(spark, [0]), points(spark, [1]).select("ts"))
    assert [(r["variant_name"], r[alarms.BEAT]) for r in joined.orderBy("ts").collect()] == [("primary", False), (None, True)]
    assert joined.where(F.col(alarms.BEAT) & F.col("latency").isNotNull()).count() == 0
