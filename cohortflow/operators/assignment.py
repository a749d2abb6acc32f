"""Buckets, experiments and variants for scored users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.draws import stable_key, uniform
from cohortflow.operators.ordering import global_index
from cohortflow.schemas import RAW_INPUTS, SCORED_COLUMNS

# Probability limits (strict), experiment names, priorities, bucket names, version.
PREMIUM_ABOVE, POTENTIAL_ABOVE = 0.8, 0.3
HIGH_VALUE, STANDARD = "high_value", "standard"
MODEL_VERSION = "unified_pipeline"

DEFAULT_SALT = "experiment"


def variant(key: Column, salt: str = DEFAULT_SALT) -> Column:
    """A or B, half each, always the same for a key and salt."""
    return F.when(uniform(key, salt, 0) > 0.5, "A").otherwise("B")


def experiment(prediction: Column, probability: Column, key: Column, salt: str = DEFAULT_SALT) -> Column:
    """Struct (experiment_type, variant, priority) for a prediction and its high-value probability."""
    high = prediction == 1
    premium = high & (probability > PREMIUM_ABOVE)
    potential = ~high & (probability > POTENTIAL_ABOVE)
    kind = (
        F.when(premium, "premium_features")
        .when(high, "engagement_boost")
        .when(potential, "conversion_optimization")
        .otherwise("basic_features")
    )
    priority = F.when(premium, "high").when(high | potential, "medium").otherwise("low")
    return F.struct(kind.alias("experiment_type"), variant(key, salt).alias("variant"), priority.alias("priority"))


def assign_experiments(
    scored: DataFrame,
    prediction: str = "predicted",
    probability: str = "p1",
    key: str = "user_id",
    salt: str = DEFAULT_SALT,
) -> DataFrame:
    """Add bucket, confidence, both probabilities, the assignment and the model version.

    A request without a key gets its variant from its inputs.
    """
    p1 = F.col(probability)
    identity = stable_key(F.col(key), [name for name in RAW_INPUTS if name in scored.columns])
    p0 = 1.0 - p1
    high = F.col(prediction) == 1
    return scored.withColumns(
        {
            "predicted_bucket": F.when(high, HIGH_VALUE).otherwise(STANDARD),
            "confidence": F.when(high, p1).otherwise(p0),
            "high_value_probability": p1,
            "standard_probability": p0,
            "experiment_assignment": experiment(F.col(prediction), p1, identity, salt),
            "model_version": F.lit(MODEL_VERSION),
        }
    )


def with_user_index(assigned: DataFrame, order_by: list[str]) -> DataFrame:
    """The seven response fields, with the position of each row in the order of ``order_by``."""
    return global_index(assigned, order_by, "user_index").select(*SCORED_COLUMNS)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
