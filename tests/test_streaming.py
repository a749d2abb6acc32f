from __future__ import annotations

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.operators import monitoring
from cohortflow.operators.assignment import assign_experiments
from cohortflow.operators.model import LOGISTIC_REGRESSION
from cohortflow.plans import jobs
from cohortflow.schemas import CORRUPT, NUMERIC_INPUTS, USER
from cohortflow.session import materialize
from cohortflow.sources import requests, synthetic
from cohortflow.sources.tables import metric_points
from cohortflow.streaming import jobs as streams

START = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def users(spark):
    return materialize(synthetic.synthetic_cohort(spark, 1500), "stream-users")


@pytest.fixture(scope="module")
def model(users):
    return jobs.train_and_evaluate(users, LOGISTIC_REGRESSION).model


def test_answers_equal_the_batch(spark, users, model, tmp_path):
    folder = str(tmp_path / "in")
    doubles = users.select("user_id", *[F.col(n).cast("double").alias(n) for n in NUMERIC_INPUTS], "gender", "location")
    doubles.repartition(4).write.json(folder)
    good = {"user_id": "z", **{n: 0.5 for n in NUMERIC_INPUTS}, "gender": "M", "location": "US"}
    with open(f"{folder}/bad.json", "w") as file:
        lines = ['{"user_id": "x", "age": "old"}', json.dumps([good | {"user_id": "y", "age": 200}, good]), "", json.dumps(good | {"gender": 5})]
        file.write("\n".join(lines) + "\n")
    stream = requests.stream_requests(spark, folder, max_files=2)
    run = lambda: streams.answer(stream, model.score, str(tmp_path / "out"), str(tmp_path / "ck"), share=0.5).awaitTermination()
    run()
    stored = spark.read.parquet(str(tmp_path / "out"))
    columns = ["user_id", "predicted_bucket", "confidence", "experiment_assignment", "model_version"]
    streamed = streams.scored_rows(stored).select(*columns)
    clean = requests.accepted(requests.read_requests(spark, folder)).where("user_id <> 'y'")
    batch = assign_experiments(model.score(clean)).select(*columns)
    assert streamed.count() == 1501
    assert streamed.exceptAll(batch).count() == 0
    refused = streams.refused_rows(stored).collect()
    assert sorted(r["user_id"] or "" for r in refused if r["text"] is None) == ["y"]
    assert len([r for r in refused if r["text"] is not None]) == 2 and len(refused) == 3
    assert stored.count() == 1504
    assert streams.captured_rows(stored).count() / 1504 == pytest.approx(0.5, abs=0.06)
    run()  # A second run finds nothing new.
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1504


def test_answer_tables(spark, users, model, tmp_path):
    """Each request is in one of two tables, and a batch that is committed again changes nothing."""
    rows = users.select("user_id", *[F.col(n).cast("double").alias(n) for n in NUMERIC_INPUTS], "gender", "location").limit(200)
    rows = rows.withColumn("age", F.when(F.col("user_id") < "user_000050", -1.0).otherwise(F.col("age")))
    rows.repartition(3).write.json(str(tmp_path / "in"))
    stream = requests.stream_requests(spark, str(tmp_path / "in"), max_files=1)
    run = lambda out, ck: streams.answer_tables(stream, model.score, out, ck, share=0.5).awaitTermination()
    out = str(tmp_path / "out")
    run(out, str(tmp_path / "ck"))
    read = lambda name: spark.read.parquet(f"{out}/{name}").drop("batch")
    counts = lambda: [read(name).count() for name in ("answers", "scored", "refused", "captured")]
    first = counts()
    refused = rows.where("age < 0").count()
    assert first[:3] == [200, 200 - refused, refused] and 60 <= first[3] <= 140
    assert read("scored").select("user_id").intersect(read("refused").select("user_id")).count() == 0
    # The same batches once more, as after a failure before the checkpoint was written.
    run(out, str(tmp_path / "other"))
    assert counts() == first and read("answers").select("user_id").distinct().count() == 200


def test_drop_folder(spark, users, tmp_path):
    folder = str(tmp_path / "drop")
    users.where("user_id < 'user_000700'").coalesce(1).write.option("header", True).csv(folder)
    query = lambda: streams.ingest(streams.drop_folder(spark, folder, USER), str(tmp_path / "o"), str(tmp_path / "c"))
    query().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 700
    users.where("user_id >= 'user_000700'").coalesce(1).write.mode("append").option("header", True).csv(folder)
    query().awaitTermination()
    arrived = spark.read.parquet(str(tmp_path / "o"))
    assert arrived.count() == 1500 and arrived.select("user_id").distinct().count() == 1500


def test_dropped_files_are_read_by_name(spark, tmp_path):
    schema = T.StructType([USER["user_id"], USER["age"]])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("user_id,age\nu1,30\nu2,old\n")
    run = lambda: streams.ingest(
        streams.drop_folder(spark, str(tmp_path / "in"), schema), str(tmp_path / "o"), str(tmp_path / "c")
    ).awaitTermination()
    run()
    rows = {r["user_id"]: r for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert rows["u1"]["age"] == 30 and rows["u1"][CORRUPT] is None
    assert rows["u2"]["age"] is None and rows["u2"][CORRUPT] == "u2,old"
    (tmp_path / "in" / "b.csv").write_text("age,user_id\n30,u3\n")
    with pytest.raises(StreamingQueryException):
        run()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def event_file(spark, folder, times, order):
    rows = [(t, "error" if i % 3 == 0 else "view", 10.0 * i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # files are taken in the order of their modification time


def test_windows_late_rows_and_alarms(spark, tmp_path):
    folder = str(tmp_path / "events")
    minute = timedelta(minutes=1)
    on_time = [
        [START + i * minute for i in range(60)],
        [START + (60 + i) * minute for i in range(60)],
        [START + (300 + i) * minute for i in range(20)],
        [START + (400 + i) * minute for i in range(5)],
    ]
    for batch, times in enumerate(on_time):
        # One row far behind in each batch after the first two; those are past the watermark.
        late = [START] if batch >= 2 else []
        event_file(spark, folder, times + late, batch)
    counter = streams.LateRows()
    spark.streams.addListener(counter)
    stream = metric_points(streams.event_stream(spark, folder, max_files=1))
    query = streams.metric_windows(stream, str(tmp_path / "w"), str(tmp_path / "c"))
    query.awaitTermination()
    windows = spark.read.parquet(str(tmp_path / "w"))
    for _ in range(50):
        if counter.dropped.get(str(query.id)) == 2:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counter)
    assert counter.dropped[str(query.id)] == 2
    everything = spark.read.parquet(folder).where(~((F.col("ts") == START) & (F.col("value") >= 50.0)))
    points = metric_points(everything.withColumn("ts", F.col("ts").cast("timestamp")))
    closed_until = START + 404 * minute - timedelta(minutes=10)
    batch = monitoring.window_statistics(points)
    expected = batch.where(F.col("period_start") + F.expr("INTERVAL 5 minutes") <= F.lit(closed_until))
    assert windows.exceptAll(expected).count() == 0 and windows.count() == expected.count()
    # With what was open at the end, all windows are there.
    drained = windows.unionByName(streams.open_windows(points, streams.watermark(query)))
    assert drained.exceptAll(batch).count() == 0 and drained.count() == batch.count()
    states = streams.alarm_states(spark, str(tmp_path / "w"), monitoring.LOW_INVOCATION)
    # Silence from 02:00 to 05:00: alarms from the sixth silent period on.
    alarms = [r["period_start"] for r in states.where("state = 'ALARM'").orderBy("period_start").collect()]
    assert alarms[0] == START + timedelta(minutes=145) and alarms[-1] == START + timedelta(minutes=295)
    later = streams.alarm_states(spark, str(tmp_path / "w"), monitoring.LOW_INVOCATION, until=streams.watermark(query))
    assert later.where("state = 'ALARM'").count() > len(alarms)


def test_windows_by_endpoint_and_variant(spark, tmp_path):
    """Points of the user's own shape, with two dimensions."""
    rows = [(START + timedelta(minutes=i), f"e{i % 2}", "A" if i % 3 else "B", float(i), int(i % 5 == 0)) for i in range(120)]
    frame = spark.createDataFrame(rows, "ts timestamp, endpoint_name string, variant_name string, latency double, err4xx int")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    dims = ["endpoint_name", "variant_name"]
    query = streams.metric_windows(stream, str(tmp_path / "w"), str(tmp_path / "c"), dims=dims)
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "w")).unionByName(streams.open_windows(frame, streams.watermark(query), dims=dims))
    assert found.exceptAll(monitoring.window_statistics(frame, dims=dims)).count() == 0
    states = monitoring.evaluate_alarm(found, monitoring.HIGH_ERROR_RATE, "5 minutes", dims)
    assert states.select(*dims).distinct().count() == 4
