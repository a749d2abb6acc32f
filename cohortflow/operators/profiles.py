"""User profiles from product reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.behaviour import review_engagement
from cohortflow.functions.draws import beta_2_3, choice, exponential, normal, poisson, uniform
from cohortflow.functions.numeric import at_least, clip, parse_number, safe_ratio, text_length, truncate
from cohortflow.schemas import FULL_USER

# Sizes of a top-up, user id prefix and the numbers behind the derived columns.
TOP_UP_FLOOR, TOP_UP_TARGET = 1_000, 5_000
USER_PREFIX = "amz_user_"
AGE_BASE, AGE_SLOPE, AGE_SD, AGE_LOW, AGE_HIGH = 25, 40, 5, 18, 80
GENDERS = [("M", 0.45), ("F", 0.5), ("Other", 0.05)]
LOCATIONS = [("US", 0.7), ("UK", 0.15), ("CA", 0.1), ("AU", 0.05)]
SESSIONS_PER_REVIEW, SESSIONS_RATE = 2, 10
DURATION_BASE, DURATION_SLOPE, DURATION_SCALE = 180, 300, 120
VIEWS_PER_SESSION, VIEWS_RATE = 3, 15
PURCHASES_RATE = 2
SPEND_BASE, SPEND_SLOPE, SPEND_SCALE = 50, 200, 100
CONVERSION_CAP, CONVERSION_SLOPE, CONVERSION_NOISE, CONVERSION_NOISE_MEAN = 0.8, 0.6, 0.4, 0.4

# Draw numbers of a profile row; the beta draw uses four from BETA on.
GENDER, LOCATION, AGE, AGE_ANGLE, SESSIONS, DURATION, VIEWS, PURCHASES, SPEND, BETA = range(10)


def first_seen_customers(reviews: DataFrame, order_by: list[str]) -> DataFrame:
    """All distinct customers with their first appearance; a missing or empty id counts as one.

    A caller that wants them in order sorts by ``_first_seen``.
    """
    return reviews.groupBy("customer_id").agg(_first_seen(order_by))


def _first_seen(order_by: list[str]) -> Column:
    # A single numeric key keeps the hash aggregate; a struct makes Spark aggregate by sorting.
    key = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    return F.min(key).alias("_first_seen")


def review_totals(reviews: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per customer with a usable id: counts, rating, votes, length and verified share.

    A single hash aggregate; a customer with very many reviews is reduced before the shuffle. With
    ``order_by`` the same aggregate carries each customer's first row as ``_first_seen``.
    """
    aggregates = [
        F.count("*").alias("review_count"),
        F.avg(parse_number(F.col("star_rating"))).alias("avg_rating"),
        F.coalesce(F.sum(parse_number(F.col("helpful_votes"))), F.lit(0.0)).alias("helpful_votes"),
        F.coalesce(F.sum(parse_number(F.col("total_votes"))), F.lit(0.0)).alias("total_votes"),
        F.avg(text_length(F.col("review_body"))).alias("avg_review_length"),
        F.count_if(F.col("verified_purchase") == "Y").alias("verified_purchases"),
    ]
    seen = [_first_seen(order_by)] if order_by else []
    totals = reviews.groupBy("customer_id").agg(*aggregates, *seen)
    return totals.where(F.col("customer_id").isNotNull() & (F.col("customer_id") != "")).withColumn(
        "verified_ratio", safe_ratio(F.col("verified_purchases"), F.col("review_count"))
    )


def usable(totals: DataFrame) -> DataFrame:
    """Customers with at least one rating that parses; the rest cannot be profiled."""
    return totals.where(F.col("avg_rating").isNotNull())


def rejected(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("avg_rating").isNull()).select("customer_id", "review_count")


def profiles_from_totals(
    totals: DataFrame, noise: bool = True, seed: int = 42, created_at: Column | None = None
) -> DataFrame:
    """User rows from review totals. ``noise=False`` puts each numeric draw at its mean."""
    key = F.col("user_id")
    score = F.col("engagement_score")

    def u(draw: int) -> Column:
        return uniform(key, seed, draw)

    def drawn(draw: Column, mean: float) -> Column:
        return draw if noise else F.lit(mean)

    scored = usable(totals).select(
        "*",
        F.concat(F.lit(USER_PREFIX), F.col("customer_id")).alias("user_id"),
        review_engagement(
            F.col("review_count"), F.col("avg_rating"), F.col("avg_review_length"), F.col("verified_ratio")
        ).alias("engagement_score"),
    )
    age = truncate(AGE_BASE + score * AGE_SLOPE + drawn(normal(u(AGE), u(AGE_ANGLE), 0, AGE_SD), 0.0))
    sessions = at_least(
        truncate(F.col("review_count") * SESSIONS_PER_REVIEW + drawn(poisson(u(SESSIONS), SESSIONS_RATE), SESSIONS_RATE), "bigint"), 1
    )
    duration = DURATION_BASE + score * DURATION_SLOPE + drawn(exponential(u(DURATION), DURATION_SCALE), DURATION_SCALE)
    purchases = at_least(F.col("verified_purchases") + drawn(poisson(u(PURCHASES), PURCHASES_RATE), PURCHASES_RATE), 0)
    price = SPEND_BASE + score * SPEND_SLOPE + drawn(exponential(u(SPEND), SPEND_SCALE), SPEND_SCALE)
    beta = drawn(beta_2_3([u(BETA + i) for i in range(4)]), CONVERSION_NOISE_MEAN)
    conversion = F.least(F.lit(CONVERSION_CAP), score * CONVERSION_SLOPE + beta * CONVERSION_NOISE)
    behaviour = scored.withColumns({"session_count": sessions, "purchase_history": purchases.cast("bigint")})
    views = truncate(F.col("session_count") * VIEWS_PER_SESSION + drawn(poisson(u(VIEWS), VIEWS_RATE), VIEWS_RATE), "bigint")
    return behaviour.select(
        "user_id",
        clip(age, AGE_LOW, AGE_HIGH).alias("age"),
        choice(u(GENDER), GENDERS).alias("gender"),
        choice(u(LOCATION), LOCATIONS).alias("location"),
        "session_count",
        duration.alias("avg_session_duration"),
        at_least(views, 1).alias("page_views"),
        "purchase_history",
        (F.col("purchase_history") * price).alias("total_spent"),
        "engagement_score",
        F.lit("").alias("previous_experiments"),
        conversion.alias("historical_conversion_rate"),
        (F.current_timestamp() if created_at is None else created_at).cast(FULL_USER["created_at"].dataType).alias("created_at"),
        "review_count",
        F.col("avg_rating").alias("avg_rating_given"),
        F.col("helpful_votes").alias("helpful_votes_received"),
        F.col("verified_ratio").alias("verified_purchase_ratio"),
    )


def review_profiles(reviews: DataFrame, noise: bool = True, seed: int = 42, created_at: Column | None = None) -> DataFrame:
    """User rows from reviews, one for each customer with a rating."""
    return profiles_from_totals(review_totals(reviews), noise, seed, created_at)


def top_up(users: DataFrame, filler, floor: int = TOP_UP_FLOOR, target: int = TOP_UP_TARGET) -> DataFrame:
    """Append ``filler(target - n)`` when there are only ``n`` users, fewer than ``floor``.

    Only for callers that ask for invented users; no loader does so by itself. Counting stops at
    ``floor``, so a large user table is not counted in full.
    """
    n = users.limit(floor).count()
    if n >= floor:
        return users
    return users.unionByName(filler(target - n), allowMissingColumns=True)
