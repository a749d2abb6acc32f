"""Column lists and schemas shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC_INPUTS = [
    "age",
    "session_count",
    "avg_session_duration",
    "page_views",
    "purchase_history",
    "total_spent",
    "engagement_score",
    "historical_conversion_rate",
]
CATEGORICAL_INPUTS = ["gender", "location"]

# The ten raw inputs of a model, in order.
RAW_INPUTS = NUMERIC_INPUTS + CATEGORICAL_INPUTS

CATEGORICAL_FEATURES = ["gender", "location", "age_group", "spending_tier"]
DERIVED_RATIOS = ["spend_per_purchase", "session_efficiency"]

# The fourteen model features, in order.
FEATURES = NUMERIC_INPUTS + DERIVED_RATIOS + [f"{name}_encoded" for name in CATEGORICAL_FEATURES]

LABEL = "high_value_user"
TARGET = "target"

USER = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("session_count", T.LongType()),
        T.StructField("avg_session_duration", T.DoubleType()),
        T.StructField("page_views", T.LongType()),
        T.StructField("purchase_history", T.LongType()),
        T.StructField("total_spent", T.DoubleType()),
        T.StructField("engagement_score", T.DoubleType()),
        T.StructField("previous_experiments", T.StringType()),
        T.StructField("historical_conversion_rate", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Columns only review-derived users have.
REVIEW_EXTRAS = T.StructType(
    [
        T.StructField("review_count", T.LongType()),
        T.StructField("avg_rating_given", T.DoubleType()),
        T.StructField("helpful_votes_received", T.DoubleType()),
        T.StructField("verified_purchase_ratio", T.DoubleType()),
    ]
)

FULL_USER = T.StructType(USER.fields + REVIEW_EXTRAS.fields)

# Review columns that the profile reads.
REVIEW_COLUMNS = ["customer_id", "star_rating", "helpful_votes", "total_votes", "review_body", "verified_purchase"]

CORRUPT = "_corrupt_record"

REQUEST = T.StructType(
    [T.StructField("user_id", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in NUMERIC_INPUTS]
    + [T.StructField(name, T.StringType()) for name in CATEGORICAL_INPUTS]
)

SCORED_COLUMNS = [
    "user_index",
    "predicted_bucket",
    "confidence",
    "high_value_probability",
    "standard_probability",
    "experiment_assignment",
    "model_version",
]
