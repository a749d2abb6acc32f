"""Scoring requests as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from cohortflow.functions.numeric import nulls_for_nan
from cohortflow.schemas import CORRUPT, REQUEST

# Fixed value: the one accepted content type.
JSON_CONTENT = "application/json"


def _schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


def _parsed_bodies(bodies: DataFrame, schema: StructType) -> DataFrame:
    """One row per request of each body (column ``value``): an object, or an array of objects; blank bodies have none.

    What does not parse, is no object, or has a value of another type than the schema says, is kept as text in
    ``_corrupt_record``: the request itself, or the whole body if an array can't be read or is empty. A text in place
    of a number, be it NaN, Infinity or digits, is of another type, and an infinite number is refused; a bare NaN, as some
    writers put it for a missing number, is missing.
    """
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    each = F.when(F.size(listed) > 0, F.transform(listed, lambda x: F.coalesce(x, F.lit("null"))))
    one = bodies.where(text != "").select(F.explode(F.coalesce(each, F.array(text))).alias("body"))
    # from_json with options parses every field even if few are selected later, so that a bad value
    # in an unselected field is still seen; the JSON file reader would skip that field.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # A text field would take a number or a list as its text, and a number some words, so a value's own type is looked up.
    texts = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, NumericType)]
    plain = F.regexp_replace("body", r":\s*[-+]?(NaN|Infinity|INF)\b", ": null")
    typed = one.select(
        "body",
        F.from_json("body", _schema(schema), options).alias("r"),
        F.from_json(plain, ", ".join(f"`{name}` variant" for name in [*texts, *numbers])).alias("t"),
    )
    other = ~F.ltrim("body").startswith("{")
    for name in texts:
        other = other | F.coalesce(~F.schema_of_variant(F.col(f"t.{name}")).isin("STRING", "VOID"), F.lit(False))
    for name in numbers:
        other = other | F.coalesce(F.schema_of_variant(F.col(f"t.{name}")) == "STRING", F.lit(False))
        other = other | F.coalesce(F.abs(F.col(f"r.{name}").cast("double")) == float("inf"), F.lit(False))
    rows = typed.select("r.*", F.when(other, F.col("body")).alias("_mistyped"))
    found = [F.when(F.col("_mistyped").isNull(), F.col(f.name)).alias(f.name) for f in schema.fields]
    return nulls_for_nan(rows.select(*found, F.coalesce(CORRUPT, "_mistyped").alias(CORRUPT)))


def read_requests(
    spark: SparkSession,
    path: str,
    multi_line: bool = False,
    content_type: str = JSON_CONTENT,
    schema: StructType = REQUEST,
) -> DataFrame:
    """One row per request object.

    A body per line by default, which splits across tasks; ``multi_line`` reads a body per file. A
    body holds one object or an array of objects.
    """
    if content_type != JSON_CONTENT:
        raise ValueError(f"only {JSON_CONTENT} is read, not {content_type}")
    return _parsed_bodies(spark.read.text(path, wholetext=multi_line), schema)


def stream_requests(spark: SparkSession, path: str, max_files: int = 1000, schema: StructType = REQUEST) -> DataFrame:
    """New files of a folder, a body per line, as a stream."""
    return _parsed_bodies(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), schema)


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined(requests: DataFrame) -> DataFrame:
    return requests.where(F.col(CORRUPT).isNotNull())
