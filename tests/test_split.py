from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortflow.operators import split


def largest_remainder(sizes, total):
    exact = [s * total / (sum(sizes) or 1) for s in sizes]
    quota = [math.floor(e) for e in exact]
    order = sorted(range(len(sizes)), key=lambda i: (-round(exact[i] - quota[i], 9), i))
    for i in order[: total - sum(quota)]:
        quota[i] += 1
    return quota


def brute_quotas(sizes):
    n = sum(sizes)
    test = largest_remainder(sizes, math.ceil(round(0.2 * n, 9)))
    rest = [s - t for s, t in zip(sizes, test)]
    return test, largest_remainder(rest, math.ceil(round(0.25 * sum(rest), 9)))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=6))
def test_quotas(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "_label int, n long")
    rows = sorted(split.quotas(df).collect(), key=lambda r: r["_label"])
    test, validation = brute_quotas(sizes)
    assert [r["n_test"] for r in rows] == test
    assert [r["n_validation"] for r in rows] == validation


def members(spark, rows, partitions):
    df = spark.createDataFrame(rows, "user_id string, y int").repartition(partitions)
    return {r["user_id"]: r["split"] for r in split.stratified_split(df, "y", "user_id").collect()}


def test_split_is_exact_and_independent_of_partitioning(spark):
    # Label 0 holds nine tenths of the rows.
    rows = [(f"u{i}", int(i % 10 == 0)) for i in range(1503)]
    found = members(spark, rows, 3)
    assert found == members(spark, rows, 13)
    expected = {}
    test, validation = brute_quotas([sum(y == label for _, y in rows) for label in (0, 1)])
    for label in (0, 1):
        keys = [u for u, y in rows if y == label]
        keys.sort(key=lambda u: (int(hashlib.md5(f"42:{u}".encode()).hexdigest()[:15], 16), u))
        for place, u in enumerate(keys):
            name = "test" if place < test[label] else "validation" if place < test[label] + validation[label] else "train"
            expected[u] = name
    assert found == expected


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_tiny_tables(spark, n):
    found = members(spark, [(f"u{i}", 0) for i in range(n)], 2)
    test, validation = brute_quotas([n])
    assert Counter(found.values()) == Counter({"test": test[0], "validation": validation[0], "train": n - test[0] - validation[0]}) - Counter()


def test_missing_label_is_a_stratum(spark):
    found = members(spark, [(f"u{i}", None if i < 50 else 1) for i in range(100)], 4)
    assert Counter(found.values()) == {"test": 20, "validation": 20, "train": 60}
    assert Counter(found[f"u{i}"] for i in range(50)) == {"test": 10, "validation": 10, "train": 30}


def test_quotas_of_a_huge_table(spark):
    sizes = [600_000_000_007, 399_999_999_989, 7]
    found = split.quotas(spark.createDataFrame(list(enumerate(sizes)), "_label int, n long")).orderBy("_label").collect()

    def shares(parts, total):
        whole = sum(parts)
        quota = [p * total // whole for p in parts]
        order = sorted(range(len(parts)), key=lambda i: (-(parts[i] * total % whole), i))
        for i in order[: total - sum(quota)]:
            quota[i] += 1
        return quota

    test = shares(sizes, math.ceil(round(0.2 * sum(sizes), 9)))
    rest = [s - t for s, t in zip(sizes, test)]
    assert [r["n_test"] for r in found] == test
    assert [r["n_validation"] for r in found] == shares(rest, math.ceil(round(0.25 * sum(rest), 9)))


def test_missing_and_repeated_keys_are_split_exactly(spark):
    rows = [(None if i < 300 else f"u{i % 50}" if i < 700 else f"v{i}", 1, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "user_id string, y int, place int")
    found = {r["place"]: r["split"] for r in split.stratified_split(df.repartition(3), "y", "user_id").collect()}
    assert Counter(found.values()) == {"test": 200, "validation": 200, "train": 600}
    again = split.stratified_split(df.repartition(7), "y", "user_id").collect()
    assert found == {r["place"]: r["split"] for r in again}
