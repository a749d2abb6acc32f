"""Processed zone: the split sets, unscaled and scaled side by side, and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.functions.numeric import nulls_for_nan
from cohortflow.schemas import CATEGORICAL_INPUTS, FEATURES, RAW_INPUTS, TARGET

SPLITS = ["train", "validation", "test"]
_SCALED = "scaled_"


def write_splits(transformed: DataFrame, path: str, label: str, fmt: str = "parquet") -> None:
    """One write of rows that carry ``split``, the raw inputs and ``features_scaled``; replaces ``path``."""
    columns = [F.col(n) for n in RAW_INPUTS]
    columns += [F.col(f"features_scaled.{n}").alias(_SCALED + n) for n in FEATURES]
    writer = transformed.select("split", F.col(label).alias(TARGET), *columns).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.partitionBy("split").format(fmt).save(path)


def read_split(spark: SparkSession, path: str, split: str, form: str = "raw", fmt: str = "parquet") -> DataFrame:
    """The rows of one split: ``raw`` gives the ten inputs, ``scaled`` the fourteen features, and the target."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    doubles = [n for n in RAW_INPUTS if n not in CATEGORICAL_INPUTS]
    integral = {"age": T.IntegerType()} | {n: T.LongType() for n in ["session_count", "page_views", "purchase_history"]}
    fields = [T.StructField(TARGET, T.IntegerType())]
    fields += [T.StructField(n, integral.get(n, T.DoubleType()) if n in doubles else T.StringType()) for n in RAW_INPUTS]
    fields += [T.StructField(_SCALED + n, T.DoubleType()) for n in FEATURES]
    fields += [T.StructField("split", T.StringType())]
    reader = spark.read.schema(T.StructType(fields)).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = nulls_for_nan(reader.load(path).where(F.col("split") == split))
    if form == "raw":
        return rows.select(*RAW_INPUTS, TARGET)
    if form == "scaled":
        return rows.select(*[F.col(_SCALED + n).alias(n) for n in FEATURES], TARGET)
    raise ValueError(f"unknown form {form}")


def write_document(document: DataFrame, path: str) -> None:
    """A one-row DataFrame as a JSON file."""
    document.coalesce(1).write.mode("overwrite").json(path)
