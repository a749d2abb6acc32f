"""Random draws that depend only on (seed, draw number, key).

A draw is a slice of an md5 digest, so results are the same for any partitioning, any retry and any
engine that has md5. One digest serves four draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_DRAWS = 4
HEX_PER_DRAW = 8


def uniform(key: Column, seed: int | str, draw: int) -> Column:
    """Uniform double in [0, 1) for the given draw number."""
    block, slot = divmod(draw, DIGEST_DRAWS)
    digest = F.md5(F.concat(F.lit(f"{seed}:{block}:"), key.cast("string")))
    word = F.conv(F.substring(digest, 1 + HEX_PER_DRAW * slot, HEX_PER_DRAW), 16, 10)
    return word.cast("double") / float(2**32)


def stable_key(key: Column, content: list[str]) -> Column:
    """``key``, or where it is missing a digest of the given columns, so that equal rows still draw alike."""
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in content]
    return F.coalesce(key.cast("string"), F.md5(F.concat_ws("|", *parts)))


def hash60(key: Column, seed: int | str) -> Column:
    """Non-negative 60-bit hash as bigint."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def normal(u1: Column, u2: Column, mean: float, sd: float) -> Column:
    """Box-Muller transform; ``1 - u1`` keeps the logarithm finite."""
    return mean + sd * F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2)


def exponential(u: Column, scale: float) -> Column:
    return -scale * F.log(1.0 - u)


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until it is 1 to within one uniform step."""
    term = total = math.exp(-rate)
    steps = [total]
    while 1.0 - total > 2.0**-32:
        term *= rate / len(steps)
        total += term
        steps.append(total)
    return steps


def poisson(u: Column, rate: float) -> Column:
    """Inverse CDF: the number of CDF steps that ``u`` has passed."""
    steps = F.array(*[F.lit(p) for p in poisson_cdf(rate)])
    # Bound as a lambda argument, so that u (a digest) is computed once and not once per step.
    passed = F.transform(F.array(u), lambda bound: F.size(F.filter(steps, lambda p: p <= bound)))
    return F.get(passed, 0).cast("bigint")


def beta_2_3(uniforms: list[Column]) -> Column:
    """Beta(2, 3) as the second smallest of four uniforms."""
    return F.array_sort(F.array(*uniforms))[1]


def choice(u: Column, weighted: list[tuple[str, float]]) -> Column:
    """Weighted choice by cumulative weight; the last value takes what is left."""
    total = 0.0
    picked = None
    for value, weight in weighted[:-1]:
        total = round(total + weight, 12)
        picked = (F if picked is None else picked).when(u < total, F.lit(value))
    return picked.otherwise(F.lit(weighted[-1][0]))


def integer(u: Column, low: int, high: int) -> Column:
    """Uniform integer in [low, high]."""
    return (low + F.floor(u * float(high - low + 1))).cast("int")
