"""Model registry and the approval gate."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Registry status and the message of a failed gate.
APPROVED = "Approved"
REJECTED_MESSAGE = "Model did not meet approval criteria"


class ModelRejected(RuntimeError):
    """Raised when a candidate does not pass the gate."""


class RegistryBusy(RuntimeError):
    """Raised when another job is writing the same registry."""


#: Each model has a partition of its own, named by this column.
_PARTITION = "model"


@contextmanager
def single_writer(spark: SparkSession, registry: str) -> Iterator[None]:
    """Marks ``registry`` as being written; a file that can be made only once keeps a second writer out."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{registry.rstrip('/')}_being_written")
    files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.createNewFile(mark):
        raise RegistryBusy(f"{registry} is being written; remove {mark} if its writer is gone")
    try:
        yield
    finally:
        files.delete(mark, False)


def _replace(rows: DataFrame, path: str) -> None:
    """Writes each model's row into its partition, in place of what is there; other models stay."""
    writer = rows.withColumn(_PARTITION, F.col("model_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(_PARTITION).parquet(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a registry or of its rejects; none if nothing has been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).drop(_PARTITION)


def approval_flag(document: Column) -> Column:
    """``approve_model`` from an approval document in JSON text; missing means not approved."""
    return F.coalesce(F.get_json_object(document, "$.approve_model") == "true", F.lit(False))


def read_approval(spark: SparkSession, path: str) -> DataFrame:
    """The approval flag of a written approval document."""
    return spark.read.text(path, wholetext=True).select(approval_flag(F.col("value")).alias("approve_model"))


def registry_rows(candidates: DataFrame, status: str = APPROVED) -> DataFrame:
    """Approved candidates (model_id, path, metrics, approve_model) as registry rows."""
    return candidates.where(F.col("approve_model")).select(
        "model_id", "path", "metrics", F.lit(status).alias("status"), F.current_timestamp().alias("registered_at")
    )


def rejected_rows(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.coalesce(F.col("approve_model"), F.lit(False))).select(
        "model_id", "path", "metrics", F.lit(REJECTED_MESSAGE).alias("reason")
    )


def gate_and_register(candidates: DataFrame, registry: str, rejects: str | None = None, status: str = APPROVED) -> None:
    """Store approved candidates in the registry, each in place of a row of the same model: doing so twice changes nothing.

    Rejected ones go to ``rejects``; without such a table the first rejected candidate raises.
    """
    with single_writer(candidates.sparkSession, registry):
        if rejects is None:
            first = rejected_rows(candidates).limit(1).collect()
            if first:
                raise ModelRejected(f"{first[0]['model_id']}: {REJECTED_MESSAGE}")
        else:
            _replace(rejected_rows(candidates), rejects)
        _replace(registry_rows(candidates, status), registry)
