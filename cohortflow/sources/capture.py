"""Capture of scoring inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.draws import stable_key, uniform
from cohortflow.schemas import RAW_INPUTS

# Fixed value: everything is captured by default.
CAPTURE_SHARE = 1.0

#: What a scored request answers.
OUTPUTS = [
    "predicted_bucket", "confidence", "high_value_probability", "standard_probability", "experiment_assignment", "model_version",
]


def captured(key: Column, share: float = CAPTURE_SHARE, salt: str = "capture") -> Column:
    """Whether a request is captured: a hash of its key, so repeats and retries decide alike."""
    return uniform(key, salt, 0) < share


def capture_rows(assigned: DataFrame, share: float = CAPTURE_SHARE, key: str = "user_id") -> DataFrame:
    """Input and output structs of the captured requests, with the capture date."""
    identity = stable_key(F.col(key), RAW_INPUTS)
    return assigned.where(captured(identity, share)).select(
        F.col(key),
        F.struct(*RAW_INPUTS).alias("input"),
        F.struct(*OUTPUTS).alias("output"),
        F.current_date().alias("capture_date"),
    )


def write_capture(assigned: DataFrame, path: str, share: float = CAPTURE_SHARE, key: str = "user_id") -> None:
    capture_rows(assigned, share, key).write.mode("append").partitionBy("capture_date").parquet(path)
