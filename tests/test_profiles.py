from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import profiles
from cohortflow.sources import synthetic

SCHEMA = "row_key int, customer_id string, star_rating string, helpful_votes string, total_votes string, review_body string, verified_purchase string"


def review_set(n=900, seed=3):
    """Reviews in which customer ``hot`` wrote a third, with missing and unparsable fields."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        customer = "hot" if i % 3 == 0 else rng.choice(["", None, "bad", *[f"c{k}" for k in range(40)]])
        rating = "n/a" if customer == "bad" else rng.choice(["1", "3", "5", "x", None])
        body = rng.choice([None, "", "fine", "long " * 150])
        rows.append((i, customer, rating, rng.choice(["2", "z", None]), "4", body, rng.choice("YN")))
    return rows


def brute_force(rows):
    """Profiles with every draw at its mean, customer by customer."""
    order = list(dict.fromkeys(r[1] for r in rows))
    found = {}
    for customer in order:
        if customer is None or customer == "":
            continue
        mine = [r for r in rows if r[1] == customer]
        ratings = [float(r[2]) for r in mine if r[2] and r[2].isdigit()]
        if not ratings:
            continue
        n, rating = len(mine), sum(ratings) / len(ratings)
        votes = sum(float(r[3]) for r in mine if r[3] and r[3].isdigit())
        length = sum(len(r[5] or "") for r in mine) / n
        verified = sum(r[6] == "Y" for r in mine)
        score = 0.3 * min(n / 10, 1) + 0.2 * rating / 5 + 0.2 * min(length / 500, 1) + 0.3 * verified / n
        sessions = max(1, 2 * n + 10)
        purchases = verified + 2
        found[f"amz_user_{customer}"] = {
            "age": max(18, min(80, math.trunc(25 + score * 40))),
            "session_count": sessions,
            "page_views": max(1, 3 * sessions + 15),
            "purchase_history": purchases,
            "avg_session_duration": 180 + score * 300 + 120,
            "total_spent": purchases * (50 + score * 200 + 100),
            "engagement_score": score,
            "historical_conversion_rate": min(0.8, score * 0.6 + 0.16),
            "review_count": n,
            "avg_rating_given": rating,
            "helpful_votes_received": votes,
            "verified_purchase_ratio": verified / n,
        }
    return found


def test_profiles_equal_brute_force(spark):
    rows = review_set()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {r["user_id"]: r.asDict() for r in profiles.review_profiles(df, noise=False).collect()}
    expected = brute_force(rows)
    assert set(found) == set(expected)
    for user, wanted in expected.items():
        assert {k: found[user][k] for k in wanted} == pytest.approx(wanted)
        assert found[user]["previous_experiments"] == ""
        assert found[user]["gender"] in ("M", "F", "Other") and found[user]["location"] in ("US", "UK", "CA", "AU")


def test_customers_without_a_rating_are_listed(spark):
    totals = profiles.review_totals(spark.createDataFrame(review_set(), SCHEMA))
    assert [r["customer_id"] for r in profiles.rejected(totals).collect()] == ["bad"]


def test_customers_by_first_appearance(spark):
    rows = review_set()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = [r["customer_id"] for r in profiles.first_seen_customers(df, ["row_key"]).orderBy("_first_seen").collect()]
    assert found == list(dict.fromkeys(r[1] for r in rows))


def test_drawn_profiles_are_repeatable(spark):
    df = spark.createDataFrame(review_set(), SCHEMA)
    stamp = F.lit("2024-01-01")
    first = profiles.review_profiles(df, created_at=stamp).collect()
    second = profiles.review_profiles(df.repartition(9), created_at=stamp).collect()
    assert sorted(map(str, first)) == sorted(map(str, second))


def test_top_up(spark):
    users = profiles.review_profiles(spark.createDataFrame(review_set(), SCHEMA), noise=False)
    n = users.count()
    filled = profiles.top_up(users, lambda missing: synthetic.synthetic_cohort(spark, missing), floor=100, target=250)
    assert filled.count() == 250
    assert filled.where(F.col("review_count").isNull()).count() == 250 - n
    kept = profiles.top_up(users, lambda missing: pytest.fail("not needed"), floor=n)
    assert kept.count() == n


def test_synthetic_cohort(spark):
    frame = synthetic.synthetic_cohort(spark, 8000).toPandas()
    assert sorted(frame.user_id) == [f"user_{i:06d}" for i in range(8000)]
    assert frame.age.between(18, 80).all()
    assert frame.session_count.mean() == pytest.approx(15, rel=0.03)
    assert frame.avg_session_duration.mean() == pytest.approx(300, rel=0.05)
    assert frame.purchase_history.mean() == pytest.approx(3, rel=0.05)
    assert ((frame.total_spent == 0) == (frame.purchase_history == 0)).all()
    assert frame.engagement_score.min() == 0 and frame.engagement_score.max() == 1
    assert frame.gender.value_counts(normalize=True)["Other"] == pytest.approx(0.04, abs=0.01)
    assert frame.location.value_counts(normalize=True)["US"] == pytest.approx(0.4, abs=0.02)
    entries = frame.previous_experiments.map(lambda t: t.split("|") if t else [])
    assert entries.map(len).mean() == pytest.approx(1, abs=0.05)
    rates = entries.map(lambda e: sum(x.endswith(":True") for x in e) / len(e) if e else 0.0)
    assert (rates - frame.historical_conversion_rate).abs().max() < 1e-12


def test_synthetic_rows_depend_on_the_id_alone(spark):
    def cohort(partitions):
        ids = spark.range(0, 300, 1, partitions)
        frame = synthetic.synthetic_users(ids, created_at=F.lit("2024-01-01")).toPandas()
        return frame.sort_values("user_id").reset_index(drop=True)

    pd.testing.assert_frame_equal(cohort(1), cohort(6))
