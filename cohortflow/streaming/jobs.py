"""Streaming jobs. Sinks are file sinks, which commit each batch exactly once.

Every job drains what is there (``availableNow``) unless a trigger is given, and resumes from its
checkpoint, which like its output belongs in storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

from cohortflow.functions.draws import stable_key
from cohortflow.functions.numeric import nulls_for_nan
from cohortflow.operators.assignment import assign_experiments
from cohortflow.operators.monitoring import DEFAULT_PERIOD, DIMENSIONS, Alarm, evaluate_alarm, window_statistics
from cohortflow.operators.validation import is_valid
from cohortflow.schemas import CORRUPT, FULL_USER, RAW_INPUTS
from cohortflow.sources.capture import CAPTURE_SHARE, OUTPUTS, captured

WATERMARK_DELAY = "10 minutes"


def _start(stream: DataFrame, out: str, checkpoint: str, partition_by: list[str] | None = None, **trigger) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**(trigger or {"availableNow": True})).start(out)


def drop_folder(spark: SparkSession, folder: str, schema: StructType = FULL_USER, max_files: int = 1000) -> DataFrame:
    """New user CSV files of a folder as a stream; a file whose header differs from the schema raises.

    A row with a value that does not parse keeps its text in ``_corrupt_record``.
    """
    marked = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    options = {"header": True, "enforceSchema": False, "columnPruning": False, "columnNameOfCorruptRecord": CORRUPT}
    return nulls_for_nan(spark.readStream.schema(marked).options(maxFilesPerTrigger=max_files, **options).csv(folder))


def ingest(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store newly arrived user rows with the date of arrival."""
    return _start(stream.withColumn("ingest_date", F.current_date()), out, checkpoint, ["ingest_date"], **trigger)


def answers(requests: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "user_id", share: float = CAPTURE_SHARE) -> DataFrame:
    """One row per request: its inputs, its text if it does not parse, ``status`` (scored or refused), the output of a
    scored one and whether it is captured. ``score`` adds ``predicted`` and ``p1``; it sees every row, and what it says
    about a refused one is dropped."""
    parses = F.col(CORRUPT).isNull() if CORRUPT in requests.columns else F.lit(True)
    text = F.col(CORRUPT) if CORRUPT in requests.columns else F.lit(None).cast("string")
    rows = requests.withColumns({"_text": text, "_ok": parses & F.coalesce(is_valid(), F.lit(False))}).drop(CORRUPT)
    assigned = assign_experiments(score(rows), key=key)
    identity = stable_key(F.col(key), [*RAW_INPUTS, "_text"])
    return assigned.select(
        F.col(key),
        F.when(F.col("_ok"), "scored").otherwise("refused").alias("status"),
        F.struct(*RAW_INPUTS).alias("input"),
        F.col("_text").alias("text"),
        F.when(F.col("_ok"), F.struct(*OUTPUTS)).alias("output"),
        captured(identity, share).alias("captured"),
        F.current_date().alias("capture_date"),
    )


def answer(
    requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "user_id", share: float = CAPTURE_SHARE, **trigger
) -> StreamingQuery:
    """Score a stream of requests and store every one of them once, partitioned by date and status."""
    return _start(answers(requests, score, key, share), out, checkpoint, ["capture_date", "status"], **trigger)


def answer_tables(
    requests: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "user_id", share: float = CAPTURE_SHARE, **trigger
) -> StreamingQuery:
    """``answer`` into separate tables below ``out``: ``scored``, ``refused`` and ``captured``.

    Each batch is answered once, into ``answers``, and the tables are taken from there. All lie in folders of the batch's
    number, which a replay overwrites, so a table never holds a batch twice; ``answers`` is written first and lists all.
    """

    def commit(batch: DataFrame, number: int) -> None:
        folder = f"{out}/answers/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        for name, rows in {"scored": scored_rows(stored, key), "refused": refused_rows(stored), "captured": captured_rows(stored)}.items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    writer = answers(requests, score, key, share).writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def scored_rows(stored: DataFrame, key: str = "user_id") -> DataFrame:
    return stored.where("status = 'scored'").select(key, "output.*")


def refused_rows(stored: DataFrame) -> DataFrame:
    return stored.where("status = 'refused'").drop("output")


def captured_rows(stored: DataFrame) -> DataFrame:
    return stored.where("captured")


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int = 1000) -> DataFrame:
    """Event files as a stream; event time becomes a zoned timestamp, which watermarks need."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    events = spark.readStream.schema(schema).options(pathGlobFilter=pattern, maxFilesPerTrigger=max_files).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def metric_windows(
    points: DataFrame,
    out: str,
    checkpoint: str,
    period: str = DEFAULT_PERIOD,
    delay: str = WATERMARK_DELAY,
    dims: list[str] = DIMENSIONS,
    **trigger,
) -> StreamingQuery:
    """Statistics of each closed window of a stream of points (ts, ``dims``, latency, err4xx), written once when the
    watermark passes its end.

    State holds one row per open window and dimension. Rows behind the watermark are dropped; see
    ``LateRows``. What is still open when an input is drained comes from ``open_windows``.
    """
    return _start(window_statistics(points.withWatermark("ts", delay), period, dims), out, checkpoint, **trigger)


def open_windows(points: DataFrame, until: str | None, period: str = DEFAULT_PERIOD, dims: list[str] = DIMENSIONS) -> DataFrame:
    """The windows of drained ``points`` (a table) that a stream with watermark ``until`` has not closed."""
    step = F.expr(f"INTERVAL {period}")
    if until is None:
        return window_statistics(points, period, dims)
    limit = F.lit(until).cast("timestamp")
    recent = points.where(F.col("ts") + step > limit)
    return window_statistics(recent, period, dims).where(F.col("period_start") + step > limit)


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop behind their watermark, over their whole run: add it to ``spark.streams``."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = str(event.progress.id)
        late = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        self.dropped[name] = self.dropped.get(name, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watermark(query: StreamingQuery) -> str | None:
    """The query's last reported watermark."""
    progress = query.lastProgress
    return progress["eventTime"].get("watermark") if progress else None


def alarm_states(
    spark: SparkSession,
    windows_path: str,
    alarm: Alarm,
    period: str = DEFAULT_PERIOD,
    dims: list[str] = DIMENSIONS,
    until: str | None = None,
) -> DataFrame:
    """Alarm states over all windows closed so far, periods without data included.

    ``until`` (see ``watermark``) adds the silent periods between the last window and that time. A
    stream without any events has no watermark progress; feed it a heartbeat to see silence.
    """
    return evaluate_alarm(spark.read.parquet(windows_path), alarm, period, dims, until)
