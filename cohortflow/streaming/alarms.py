"""Alarm states of a stream, kept batch by batch, with a heartbeat that makes silence visible.

Windows of the stream close when its watermark passes their end. Each batch of closed windows is judged together with the
last periods of each dimension that the batch before it left behind, so a batch reads what is new and a few rows per
dimension, however long the history is. All that a batch writes lies in folders of its number, which a replay of the
batch overwrites: every period has one state.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortflow.operators.monitoring import DEFAULT_PERIOD, DIMENSIONS, Alarm, evaluate_alarm, same_dimensions, window_statistics
from cohortflow.session import materialize, scratch_scope
from cohortflow.streaming.jobs import WATERMARK_DELAY

#: Marks the rows of a heartbeat.
BEAT = "is_beat"


def heartbeat(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A clock as a stream: one row (ts) at a time, whether anything happens or not."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("timestamp").alias("ts"))


def with_heartbeat(points: DataFrame, beats: DataFrame) -> DataFrame:
    """``points`` and the times ``ts`` of ``beats`` in one stream, so that its watermark moves on without points."""
    empty = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c != "ts"]
    return points.withColumn(BEAT, F.lit(False)).unionByName(beats.select("ts", *empty, F.lit(True).alias(BEAT)))


def next_states(
    windows: DataFrame, tail: DataFrame | None, alarm: Alarm, period: str, dims: list[str] = DIMENSIONS, until: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States of the periods after ``tail``, the tail for the next call, and windows that came too late to be judged.

    ``tail`` holds the last ``periods`` - 1 periods (``period_start``, dims, ``value``) of each dimension, one at least, or
    fewer if there were no more. With ``until`` the periods up to that time count as silent for every dimension known so far.
    """
    valued = windows.select("period_start", *dims, F.col(alarm.statistic).alias("value"))
    late = valued.limit(0)
    known = valued
    if tail is not None:
        last = tail.groupBy(*dims).agg(F.max("period_start").alias("judged_to"))
        behind = same_dimensions("w", "l", dims) & (F.col("w.period_start") <= F.col("l.judged_to"))
        late = valued.alias("w").join(last.alias("l"), behind, "left_semi")
        known = valued.alias("w").join(last.alias("l"), behind, "left_anti").unionByName(tail)
    # Written, as the states, the next tail and the ends of the dimensions are all taken from it.
    judged = materialize(evaluate_alarm(known, replace(alarm, statistic="value"), period, dims, until), "judged")
    states = judged
    if tail is not None:
        states = judged.alias("w").join(last.alias("l"), same_dimensions("w", "l", dims) & (F.col("w.period_start") <= F.col("l.judged_to")), "left_anti")
    ends = judged.groupBy(*dims).agg(F.max("period_start").alias("end"))
    recent = F.col("w.period_start") + F.expr(f"INTERVAL {period}") * F.lit(max(alarm.periods - 1, 1)) > F.col("l.end")
    kept = judged.alias("w").join(ends.alias("l"), same_dimensions("w", "l", dims) & recent, "left_semi")
    return states, kept.select("period_start", *dims, "value"), late


class AlarmLog:
    """The states of one alarm below a folder: ``states``, ``windows``, ``late`` and ``tail``, each by batch number."""

    def __init__(self, path: str, alarm: Alarm, period: str = DEFAULT_PERIOD, dims: list[str] = DIMENSIONS):
        self.path, self.alarm, self.period, self.dims = path, alarm, period, dims

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def _tails(self, spark: SparkSession) -> list[int]:
        """Batches whose tail has been committed, in order; the newest two are kept."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tail")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        paths = [status.getPath() for status in files.listStatus(folder)]
        done = [p for p in paths if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def add(self, closed: DataFrame, batch: int) -> None:
        """Judges a batch of closed windows, heartbeats among them or not. The same batch may come again."""
        spark = closed.sparkSession
        # Stored first: the batch is read several times, and its windows are a result of their own.
        closed.write.mode("overwrite").parquet(self._folder("windows", batch))
        closed = spark.read.schema(closed.schema).parquet(self._folder("windows", batch))
        until = None
        if BEAT in closed.columns:
            end = F.max(F.when(F.col(BEAT), F.col("period_start") + F.expr(f"INTERVAL {self.period}")))
            until = closed.agg(end.cast("string")).first()[0]
            closed = closed.where(~F.col(BEAT)).drop(BEAT)
        earlier = [number for number in self._tails(spark) if number < batch]
        tail = spark.read.parquet(self._folder("tail", earlier[-1])) if earlier else None
        with scratch_scope(spark):
            states, kept, late = next_states(closed, tail, self.alarm, self.period, self.dims, until)
            states.write.mode("overwrite").parquet(self._folder("states", batch))
            late.write.mode("overwrite").parquet(self._folder("late", batch))
            kept.write.mode("overwrite").parquet(self._folder("tail", batch))
        for number in earlier[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(self._folder("tail", number))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def states(self, spark: SparkSession) -> DataFrame:
        """All states so far: ``period_start``, dims, ``value``, ``state``."""
        return spark.read.parquet(f"{self.path}/states").drop("batch")


def watch(log: AlarmLog, points: DataFrame, checkpoint: str, delay: str = WATERMARK_DELAY, **trigger) -> StreamingQuery:
    """Keeps ``log`` for a stream of points (ts, dims, latency, err4xx), with a heartbeat or without."""
    dims = [*log.dims, BEAT] if BEAT in points.columns else log.dims
    windows = window_statistics(points.withWatermark("ts", delay), log.period, dims)
    writer = windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(log.add)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
