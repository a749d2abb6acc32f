"""Expressions on one user row: engagement, ratios and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortflow.functions.numeric import at_least, at_most

# Weights of the behavioural engagement score.
SESSION_WEIGHT, DURATION_WEIGHT, VIEW_WEIGHT, SPEND_WEIGHT = 0.3, 0.2, 0.3, 0.2

# Weights and saturation points of the review engagement score.
REVIEW_COUNT_WEIGHT, RATING_WEIGHT, REVIEW_LENGTH_WEIGHT, VERIFIED_WEIGHT = 0.3, 0.2, 0.2, 0.3
REVIEW_COUNT_FULL, RATING_FULL, REVIEW_LENGTH_FULL = 10, 5, 500

# Right-closed bins as (upper edge, label); the first lower edge is open.
AGE_FLOOR = 0
AGE_BINS = [(25, "young"), (35, "adult"), (50, "middle_aged"), (100, "senior")]
SPEND_FLOOR = -1
SPEND_BINS = [(0, "none"), (50, "low"), (200, "medium"), (None, "high")]


def raw_engagement() -> Column:
    """Weighted sum of log-scaled activity; missing if any part is missing."""
    return (
        SESSION_WEIGHT * F.log1p("session_count")
        + DURATION_WEIGHT * F.log1p(F.col("avg_session_duration") / 60.0)
        + VIEW_WEIGHT * F.log1p("page_views")
        + SPEND_WEIGHT * F.log1p("total_spent")
    )


def review_engagement(reviews: Column, rating: Column, length: Column, verified_ratio: Column) -> Column:
    """Linear score in which count and length saturate at 1."""
    return (
        REVIEW_COUNT_WEIGHT * at_most(reviews / float(REVIEW_COUNT_FULL), 1.0)
        + RATING_WEIGHT * (rating / float(RATING_FULL))
        + REVIEW_LENGTH_WEIGHT * at_most(length / float(REVIEW_LENGTH_FULL), 1.0)
        + VERIFIED_WEIGHT * verified_ratio
    )


def spend_per_purchase() -> Column:
    purchases = F.col("purchase_history")
    # NaN/null purchases fail the comparison and so give 0; the divisor is guarded for ANSI mode.
    return F.when(F.coalesce(purchases > 0, F.lit(False)), F.try_divide(F.col("total_spent"), purchases)).otherwise(0.0)


def session_efficiency() -> Column:
    return F.try_divide(F.col("page_views").cast("double"), at_least(F.col("session_count"), 1).cast("double"))


def right_closed_bin(value: Column, floor: float, bins: list[tuple[float | None, str]]) -> Column:
    """Label of the bin ``(previous edge, edge]`` holding ``value``; null outside all bins."""
    # A chain of upper edges, so each branch needs only one comparison.
    label = F.when(value <= floor, F.lit(None).cast("string"))
    for edge, name in bins:
        label = label.when(value <= edge if edge is not None else value.isNotNull(), F.lit(name))
    return label


def age_group(age: Column | None = None) -> Column:
    return right_closed_bin(F.col("age") if age is None else age, AGE_FLOOR, AGE_BINS)


def spending_tier(spent: Column | None = None) -> Column:
    return right_closed_bin(F.col("total_spent") if spent is None else spent, SPEND_FLOOR, SPEND_BINS)
