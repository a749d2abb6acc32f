"""Text forms of time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The compact stamp of a run, and ISO 8601 with microseconds only where there are any.
COMPACT_FORMAT = "yyyyMMdd_HHmmss"
ISO_SECONDS, ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def compact_stamp(ts: Column) -> Column:
    return F.date_format(ts, COMPACT_FORMAT)


def iso_text(ts: Column) -> Column:
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, F.date_format(ts, ISO_SECONDS)).otherwise(F.date_format(ts, ISO_MICROS))
