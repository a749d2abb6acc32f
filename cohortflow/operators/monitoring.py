"""Metric windows and threshold alarms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PERIOD = "5 minutes"
DIMENSIONS = ["variant_name"]


@dataclass(frozen=True)
class Alarm:
    """An alarm fires when all of the last ``periods`` periods breach the threshold.

    ``statistic`` is a column of ``metric_windows``; ``missing_breaches`` says whether a period
    without data counts as a breach.
    """

    name: str
    statistic: str
    above: bool
    threshold: float
    periods: int
    missing_breaches: bool

    def breach(self, value: Column) -> Column:
        crossed = value > self.threshold if self.above else value < self.threshold
        return F.coalesce(crossed, F.lit(self.missing_breaches))


# The three alarms.
HIGH_LATENCY = Alarm("high_latency", "avg_latency", True, 5000, 2, False)
HIGH_ERROR_RATE = Alarm("high_error_rate", "errors", True, 10, 2, False)
LOW_INVOCATION = Alarm("low_invocation", "invocations", False, 1, 6, True)


def window_statistics(points: DataFrame, period: str = DEFAULT_PERIOD, dims: list[str] = DIMENSIONS) -> DataFrame:
    """Average latency, sum of errors and number of invocations per period; for tables and streams."""
    return (
        points.groupBy(F.window("ts", period).alias("w"), *dims)
        .agg(
            F.avg("latency").alias("avg_latency"),
            F.sum("err4xx").alias("errors"),
            F.count("*").alias("invocations"),
        )
        .select(F.col("w.start").alias("period_start"), *dims, "avg_latency", "errors", "invocations")
    )


def same_dimensions(left: str, right: str, dims: list[str]) -> Column:
    """Equal dimensions of two aliased tables; a missing dimension equals a missing one."""
    same = F.lit(True)
    for name in dims:
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


#: Periods that one task evaluates together.
CHUNK = 288


def dense_periods(
    windows: DataFrame, period: str, dims: list[str] = DIMENSIONS, until: str | None = None, overlap: int = 0
) -> DataFrame:
    """Every period between a dimension's first and last one; periods without data have null statistics.

    Periods are numbered from the first one and cut into chunks of ``CHUNK``, so that no task holds a whole
    dimension. Each chunk also holds the ``overlap`` periods before it; ``own`` says which are its own. With
    ``until`` the last period is the last one that ends by that time.
    """
    names = [*dims, "period_start"]
    length = f"timestampdiff(SECOND, first, first + INTERVAL {period})"
    last = F.col("last")
    if until is not None:
        ends = F.lit(until).cast(windows.schema["period_start"].dataType) - F.expr(f"INTERVAL {period}")
        last = F.greatest(last, ends)
    bounds = windows.groupBy(*dims).agg(F.min("period_start").alias("first"), F.max("period_start").alias("last"))
    bounds = bounds.withColumn("last", last).withColumn("_length", F.expr(length))
    bounds = bounds.withColumn("_count", F.expr("timestampdiff(SECOND, first, last) div _length"))
    chunks = bounds.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_count div {CHUNK}"))))
    begin = F.greatest(F.lit(0).cast("long"), F.col("_chunk") * CHUNK - overlap)
    end = F.least(F.col("_count"), F.col("_chunk") * CHUNK + CHUNK - 1)
    periods = chunks.withColumn("_place", F.explode(F.sequence(begin, end))).select(
        *dims,
        "_chunk",
        (F.col("_place") >= F.col("_chunk") * CHUNK).alias("own"),
        F.expr("first + make_dt_interval(0, 0, 0, cast(_place * _length AS decimal(18, 6)))").cast(windows.schema["period_start"].dataType).alias("period_start"),
    )
    statistics = [c for c in windows.columns if c not in names]
    return periods.alias("p").join(windows.alias("w"), same_dimensions("p", "w", names), "left").select("p.*", *[F.col(f"w.{c}").alias(c) for c in statistics])


def evaluate_alarm(
    windows: DataFrame, alarm: Alarm, period: str, dims: list[str] = DIMENSIONS, until: str | None = None
) -> DataFrame:
    """State per period: ALARM, OK, or INSUFFICIENT_DATA until ``periods`` periods have passed.

    Works on one row per period and dimension (a stored table of windows), not on the events behind them.
    """
    recent = Window.partitionBy(*dims, "_chunk").orderBy("period_start").rowsBetween(1 - alarm.periods, 0)
    value = F.col(alarm.statistic)
    breaches = F.sum(alarm.breach(value).cast("int")).over(recent)
    state = (
        F.when(F.count("*").over(recent) < alarm.periods, "INSUFFICIENT_DATA")
        .when(breaches == alarm.periods, "ALARM")
        .otherwise("OK")
    )
    dense = dense_periods(windows, period, dims, until, alarm.periods - 1)
    judged = dense.select("period_start", *dims, value.alias("value"), state.alias("state"), "own")
    return judged.where("own").drop("own")
