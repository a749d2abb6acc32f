"""Tab-separated review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.schemas import CORRUPT, REVIEW_COLUMNS

# Key columns that together give the order of rows in the files.
FILE_ORDER = ["_file", "_block", "_line"]


class MalformedFile(ValueError):
    """Raised for a file that lacks a needed column."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """All rows as text columns, with the line itself for rows longer than the header.

    The header of every file is checked against that of the first one, so files with other columns,
    or with the same in another order, raise instead of being read by position.
    """
    # Without column pruning, as the length of a row is only seen when all its fields are parsed.
    options = {"enforceSchema": False, "columnPruning": False, "columnNameOfCorruptRecord": CORRUPT}
    reader = spark.read.options(sep="\t", header=True, quote="", escape="", **options)
    names = reader.csv(path).columns
    missing = [name for name in REVIEW_COLUMNS if name not in names]
    if missing:
        raise MalformedFile(f"review file lacks columns {missing}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    # The reader marks rows of any other length; short ones are padded with nulls and stay.
    fields = F.size(F.split(F.regexp_replace(CORRUPT, r"\s+$", ""), "\t"))
    rows = reader.schema(schema).csv(path)
    return rows.withColumn(CORRUPT, F.when(fields > len(names), F.col(CORRUPT)))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Rows of header-first TSV files, every field text, quotes and backslashes taken literally.

    Short rows are padded with nulls; rows with more fields than the header are left out, see
    ``overlong_rows``. ``_file``, ``_block`` and ``_line`` order rows as in the files: rows of a block
    are read by one task in file order, whatever the number of tasks. A compressed file is one block.
    """
    kept = _lines(spark, path).where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return kept.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def overlong_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of the rows that ``read_reviews`` leaves out, trailing blanks aside."""
    # Names a second column, as the reader does not answer for the marked lines alone.
    refused = _lines(spark, path).where(F.coalesce(CORRUPT, "customer_id") == F.col(CORRUPT))
    return refused.select(F.col(CORRUPT).alias("line"), F.col("_metadata.file_path").alias("file"))


def write_reviews(reviews: DataFrame, path: str) -> None:
    """Write reviews as gzip TSV with a header; tabs and line breaks inside a field become blanks."""
    flat = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ").alias(c) for c in reviews.columns]
    # "\u0000" as quote: fields are written as they are.
    reviews.select(*flat).write.options(
        sep="\t", header=True, quote="\u0000", escapeQuotes=False, compression="gzip", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
