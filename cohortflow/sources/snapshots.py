"""Raw zone: one run per time stamp, and reading back the newest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortflow.functions.numeric import nulls_for_nan
from cohortflow.schemas import FULL_USER

# Time stamp format of a run and folder of user files.
STAMP_FORMAT = "%Y%m%d_%H%M%S"
RAW_FOLDER = "experiment-data"


def write_raw(users: DataFrame, zone: str, stamp: str | None = None, fmt: str = "csv") -> dict:
    """Append one run below ``zone``; returns its location and row count, counted during the write."""
    stamp = stamp or datetime.now().strftime(STAMP_FORMAT)
    location = f"{zone}/{RAW_FOLDER}/ingest_ts={stamp}"
    seen = Observation("raw_rows")
    writer = users.observe(seen, F.count("*").alias("rows")).write
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(location)
    return {"location": location, "rows": seen.get["rows"]}


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    # binaryFile without its content column lists files and reads none of them.
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def latest_run(spark: SparkSession, zone: str, schema: StructType = FULL_USER, fmt: str = "csv") -> DataFrame:
    """The run with the greatest stamp; other runs are pruned by partition."""
    root = f"{zone}/{RAW_FOLDER}"
    newest = _listing(spark, root, "part-*").agg(F.max("ingest_ts")).first()[0]
    if newest is None:
        raise ValueError(f"no runs below {root}")
    return _load(spark, schema, fmt, f"{root}/ingest_ts={newest}")


def latest_file(spark: SparkSession, folder: str, schema: StructType = FULL_USER) -> DataFrame:
    """The CSV file with the greatest name in a flat folder; no other file is read."""
    files = _listing(spark, folder, "*.csv")
    newest = files.agg(F.max(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), "path"))).first()[0]
    if newest is None:
        raise ValueError(f"no CSV files in {folder}")
    return _load(spark, schema, "csv", newest["path"])


def _load(spark: SparkSession, schema: StructType, fmt: str, path: str) -> DataFrame:
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, enforceSchema=False)
    return nulls_for_nan(reader.load(path))
