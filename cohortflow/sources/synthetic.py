"""Synthetic cohort: every row is a function of its id and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.draws import choice, exponential, integer, normal, poisson, poisson_cdf, uniform
from cohortflow.functions.history import HISTORY_TYPE, conversion_rate, format_history
from cohortflow.functions.numeric import clip, truncate
from cohortflow.operators.features import with_engagement
from cohortflow.schemas import USER

# Distributions of the cohort.
DEFAULT_USERS = 10_000
AGE_MEAN, AGE_SD, AGE_LOW, AGE_HIGH = 35, 12, 18, 80
GENDERS = [("M", 0.48), ("F", 0.48), ("Other", 0.04)]
LOCATIONS = [("US", 0.4), ("UK", 0.15), ("CA", 0.1), ("AU", 0.1), ("DE", 0.15), ("FR", 0.1)]
SESSIONS_RATE, DURATION_SCALE, VIEWS_RATE = 15, 300, 25
PURCHASES_RATE, SPEND_SCALE = 3, 200
EXPERIMENTS_RATE, EXPERIMENT_NUMBERS = 1, 10
VARIANTS = [("A", 1 / 3), ("B", 1 / 3), ("C", 1 / 3)]

# Draw numbers of a user row.
AGE, AGE_ANGLE, GENDER, LOCATION, SESSIONS, DURATION, VIEWS, PURCHASES, SPEND, EXPERIMENTS = range(10)


def _history(id_: Column, seed: int) -> Column:
    """Poisson-many entries; each entry has a digest of its own, keyed by user and position."""
    count = poisson(uniform(id_, seed, EXPERIMENTS), EXPERIMENTS_RATE).cast("int")
    positions = F.sequence(F.lit(1), F.lit(len(poisson_cdf(EXPERIMENTS_RATE))))

    def entry(position: Column) -> Column:
        key = F.concat_ws(":", id_.cast("string"), position.cast("string"))
        number = integer(uniform(key, f"{seed}:entry", 0), 1, EXPERIMENT_NUMBERS)
        return F.struct(
            F.concat(F.lit("exp_"), number.cast("string")).alias("experiment"),
            choice(uniform(key, f"{seed}:entry", 1), VARIANTS).alias("variant"),
            (uniform(key, f"{seed}:entry", 2) < 0.5).alias("converted"),
        )

    return F.transform(F.slice(positions, F.lit(1), count), entry).cast(HISTORY_TYPE)


def synthetic_users(ids: DataFrame, seed: int = 42, created_at: Column | None = None) -> DataFrame:
    """One user per row of ``ids`` (column ``id`` bigint), in the user schema."""
    id_ = F.col("id")

    def u(draw: int) -> Column:
        return uniform(id_, seed, draw)

    purchases = poisson(u(PURCHASES), PURCHASES_RATE)
    drawn = ids.select(
        F.format_string("user_%06d", id_).alias("user_id"),
        clip(truncate(normal(u(AGE), u(AGE_ANGLE), AGE_MEAN, AGE_SD)), AGE_LOW, AGE_HIGH).alias("age"),
        choice(u(GENDER), GENDERS).alias("gender"),
        choice(u(LOCATION), LOCATIONS).alias("location"),
        poisson(u(SESSIONS), SESSIONS_RATE).alias("session_count"),
        exponential(u(DURATION), DURATION_SCALE).alias("avg_session_duration"),
        poisson(u(VIEWS), VIEWS_RATE).alias("page_views"),
        purchases.alias("purchase_history"),
        F.when(purchases > 0, exponential(u(SPEND), SPEND_SCALE)).otherwise(0.0).alias("total_spent"),
        _history(id_, seed).alias("_history"),
    )
    return with_engagement(drawn).select(
        "user_id",
        "age",
        "gender",
        "location",
        "session_count",
        "avg_session_duration",
        "page_views",
        "purchase_history",
        "total_spent",
        "engagement_score",
        format_history(F.col("_history")).alias("previous_experiments"),
        conversion_rate(F.col("_history")).alias("historical_conversion_rate"),
        (F.current_timestamp() if created_at is None else created_at).cast(USER["created_at"].dataType).alias("created_at"),
    )


def synthetic_cohort(spark: SparkSession, n: int = DEFAULT_USERS, seed: int = 42) -> DataFrame:
    return synthetic_users(spark.range(n), seed)
