"""Choice of the user source."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators.profiles import review_profiles, top_up
from cohortflow.session import materialize
from cohortflow.sources.reviews import overlong_rows, read_reviews
from cohortflow.sources.synthetic import DEFAULT_USERS, synthetic_cohort

log = logging.getLogger(__name__)

SYNTHETIC, REVIEWS = "synthetic", "reviews"


def _is_reviews(kind: str) -> bool:
    # "reviews" or any "<shop>-reviews".
    return kind.rsplit("-", 1)[-1] == REVIEWS


def users_from_reviews(
    spark: SparkSession, path: str, rejects: str | None = None, fill: bool = False, noise: bool = True, seed: int = 42
) -> DataFrame:
    """Profiles of all customers of the review files.

    Lines that are longer than their header cost only themselves; with ``rejects`` they are stored
    there. ``fill`` adds synthetic users when there are few, and is off unless asked for.
    """
    if rejects is not None:
        overlong_rows(spark, path).write.mode("append").parquet(rejects)
    profiles = review_profiles(read_reviews(spark, path), noise, seed).withColumn("data_source", F.lit(REVIEWS))
    # Stored, so that counting the users does not read the reviews again.
    profiles = materialize(profiles, "profiles")
    if not fill:
        return profiles
    return top_up(profiles, lambda n: synthetic_cohort(spark, n, seed).withColumn("data_source", F.lit(SYNTHETIC)))


def load_users(
    spark: SparkSession,
    kind: str,
    path: str | None = None,
    on_error: str = "raise",
    n: int = DEFAULT_USERS,
    seed: int = 42,
    **options,
) -> DataFrame:
    """Users of the chosen source; ``data_source`` says where each row really comes from.

    An unknown kind or an unreadable file raises, or gives the synthetic cohort with
    ``on_error="fallback"``.
    """
    if on_error not in ("fallback", "raise"):
        raise ValueError(f"unknown on_error {on_error}")

    def fallback() -> DataFrame:
        return synthetic_cohort(spark, n, seed).withColumn("data_source", F.lit(SYNTHETIC))

    if kind == SYNTHETIC:
        return fallback()
    try:
        if not _is_reviews(kind):
            raise ValueError(f"unknown dataset {kind}")
        if path is None:
            raise ValueError("a review source needs a path")
        return users_from_reviews(spark, path, seed=seed, **options)
    except (PySparkException, Py4JJavaError, ValueError) as error:
        if on_error == "raise":
            raise
        log.warning("%s cannot be read, using synthetic users: %s", kind, error)
        return fallback()
