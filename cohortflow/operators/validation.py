"""Checks of scoring requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from cohortflow.schemas import CATEGORICAL_INPUTS, NUMERIC_INPUTS, RAW_INPUTS

# Allowed ranges (low, high), both inclusive, and the known gender spellings.
RANGES = {
    "age": (0, 120),
    "session_count": (0, None),
    "avg_session_duration": (0, None),
    "page_views": (0, None),
    "purchase_history": (0, None),
    "total_spent": (0, None),
    "engagement_score": (0, 1),
    "historical_conversion_rate": (0, 1),
}
GENDER_VALUES = ["male", "female", "other", "M", "F", "O"]


class InvalidInput(ValueError):
    """Raised when a batch breaks a rule and the mode is ``fail``."""


def require_columns(df: DataFrame, names: list[str] = RAW_INPUTS) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise InvalidInput(f"inputs that are not there: {missing}")
    return df


def require_types(df: DataFrame) -> DataFrame:
    """Every numeric input must be a numeric column and every categorical input a string column."""
    for name in RAW_INPUTS:
        wanted = StringType if name in CATEGORICAL_INPUTS else NumericType
        if not isinstance(df.schema[name].dataType, wanted):
            raise InvalidInput(f"{name} can't be {df.schema[name].dataType.simpleString()}")
    return df


def rules() -> list[tuple[str, str, Column]]:
    """(column, rule, violated) in the order of the inputs. A missing number breaks no rule; a missing
    category is not a text and breaks the type rule."""
    checks: list[tuple[str, str, Column]] = []
    for name in NUMERIC_INPUTS:
        low, high = RANGES[name]
        value = F.col(name)
        if low is not None:
            checks.append((name, "minimum", F.coalesce(value < low, F.lit(False))))
        if high is not None:
            checks.append((name, "maximum", F.coalesce((value > high) & ~F.isnan(value.cast("double")), F.lit(False))))
    for name in CATEGORICAL_INPUTS:
        checks.append((name, "type", F.col(name).isNull()))
    return checks


def validation_report(df: DataFrame) -> DataFrame:
    """(column, rule, n_bad) for every rule, from one pass over the rows."""
    checks = rules()
    counted = df.agg(*[F.count_if(bad).alias(f"{name}_{rule}") for name, rule, bad in checks])
    lines = [
        F.struct(F.lit(name).alias("column"), F.lit(rule).alias("rule"), F.col(f"{name}_{rule}").alias("n_bad"))
        for name, rule, _ in checks
    ]
    return counted.select(F.inline(F.array(*lines)))


def is_valid() -> Column:
    ok = F.lit(True)
    for _, _, bad in rules():
        ok = ok & ~bad
    return ok


def observed(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` with the rules counted along the way, and a check to call when a job over it has ended: it raises on the first
    rule that any row broke."""
    require_types(require_columns(df))
    observation = Observation()
    checks = rules()
    counted = df.observe(observation, *[F.count_if(bad).alias(f"{name}_{rule}") for name, rule, bad in checks])

    def check() -> None:
        for name, rule, _ in checks:
            _refuse(name, rule, observation.get[f"{name}_{rule}"])

    return counted, check


def _refuse(name: str, rule: str, rows: int) -> None:
    if rows:
        raise InvalidInput(f"Values in {name} break the {rule} rule: {rows} rows")


def validate(df: DataFrame, mode: str = "fail") -> DataFrame:
    """Check columns, types and ranges.

    ``fail`` raises on the first rule any row breaks, ``quarantine`` adds a column ``is_valid`` and
    ``report`` returns the counts per rule.
    """
    require_types(require_columns(df))
    if mode == "report":
        return validation_report(df)
    if mode == "quarantine":
        return df.withColumn("is_valid", is_valid())
    if mode != "fail":
        raise ValueError(f"unknown mode {mode}")
    for row in validation_report(df).collect():  # one row per rule
        _refuse(row["column"], row["rule"], row["n_bad"])
    return df


def unknown_values(df: DataFrame, column: str = "gender", allowed: list[str] = GENDER_VALUES) -> DataFrame:
    """Values outside the allowed list and how often they occur; a warning, not an error."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).groupBy(column).agg(F.count("*").alias("n"))


# Optional spelling map for callers that want request spellings to meet the trained ones.
GENDER_SPELLINGS = {"male": "M", "female": "F", "other": "Other", "O": "Other"}


def normalise_gender(df: DataFrame) -> DataFrame:
    value = F.col("gender")
    for spelling, trained in GENDER_SPELLINGS.items():
        value = F.when(F.col("gender") == spelling, trained).otherwise(value)
    return df.withColumn("gender", value)
