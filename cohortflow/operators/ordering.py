"""Order-dependent results without a one-task sort.

``running_totals`` gives cumulative sums over a global order, ``global_index`` positions in it; ``exact_quantiles`` gives
numpy-style interpolated quantiles by counting values in ever narrower buckets, without a sort or a sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.session import materialize

# Bits of a value that one pass of the quantile search tells apart: a pass returns at most 2 ** LEVEL_BITS counts for
# each bucket that holds a wanted rank. A bucket with no more values than that is resolved to single values at once.
LEVEL_BITS = 12
# Places within a range partition take these bits of a row's number, its partition the bits above.
_PLACE_BITS = 33


def running_totals(df: DataFrame, order_by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add ``<name>`` = sum of the given expression over all rows strictly before this one.

    ``order_by`` must identify a row (aggregate ties first). Rows are range-partitioned by it and
    written once, so that partition numbers stay the same in both following passes; one row per
    partition carries the totals of all earlier partitions.
    """
    valued = df.select("*", *[expr.alias(f"_{name}") for name, expr in sums.items()])
    ranged = materialize(valued.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id()), "ranged")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: the number of shuffle partitions bounds this table.
    offsets = (
        ranged.groupBy("_part")
        .agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
        .select("_part", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}_offset") for name in sums])
    )
    within = Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "_part").select(
        *[F.col(name) for name in df.columns],
        *[
            (F.coalesce(F.sum(f"_{name}").over(within), F.lit(0)) + F.col(f"_{name}_offset")).alias(name)
            for name in sums
        ],
    )


def global_index(df: DataFrame, order_by: list[str], name: str = "user_index") -> DataFrame:
    """Position (from 0) of each row in the global order; rows that are equal in ``order_by`` are placed one by one.

    Wide rows move once, to their range partition, and are written there in order with their place; one count per
    partition gives the offsets, which are added where the written rows are read.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", _PLACE_BITS)
    sizes = {row["part"]: row["count"] for row in placed.groupBy(part.alias("part")).count().collect()}  # one row per range partition
    offsets, before = [], 0
    for number in range(max(sizes, default=-1) + 1):
        offsets.append(str(before))
        before += sizes.get(number, 0)
    # One text, folded to an array when the plan is made.
    offset = F.get(F.split(F.lit(",".join(offsets)), ",").cast("array<bigint>"), part.cast("int"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (offset + place).alias(name))


def sortable(value: Column) -> Column:
    """A whole number in the order of the doubles: sign, exponent and fraction, as in their bits; -0.0 equals 0.0."""
    v = value.cast("double")
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e)
    # The logarithm may round across a power of two.
    exponent = F.when(size < power(guess), guess - 1).when(size >= power(guess + 1), guess + 1).otherwise(guess)
    fraction = ((size / power(exponent) - 1.0) * float(1 << 52)).cast("long")
    bits = (
        F.when(size < 2.0**-1022, (size * 2.0**1000 * 2.0**74).cast("long"))
        .when(size > 1.7976931348623157e308, F.lit(2047 << 52))
        .otherwise((exponent + 1023) * F.lit(1 << 52) + fraction)
    )
    return F.when(v < 0, -bits).otherwise(bits)


class _Bucket:
    """Values of one column whose sortable numbers agree above ``shift`` bits, and the ranks wanted among them."""

    def __init__(self, column: str, shift: int, prefix: int | None, size: int | None, ranks: set[int]):
        self.column, self.shift, self.prefix, self.size, self.ranks = column, shift, prefix, size, ranks

    def next_shift(self, bits: int) -> int:
        return 0 if self.size is not None and self.size <= 1 << bits else max(0, self.shift - bits)


def _counts(df: DataFrame, buckets: list[_Bucket], bits: int) -> list[dict[int, tuple[int, float, float]]]:
    """For each bucket the number, least and greatest of its values by the next bits: one pass for all of them."""
    parts = []
    for place, b in enumerate(buckets):
        value = F.col(b.column).cast("double")
        key = sortable(value)
        inside = value.isNotNull() & ~F.isnan(value)
        if b.prefix is not None:
            inside = inside & (F.shiftright(key, b.shift) == b.prefix)
        parts.append(F.when(inside, F.struct(F.lit(place).alias("bucket"), F.shiftright(key, b.next_shift(bits)).alias("part"), value.alias("value"))))
    rows = df.select(F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    found = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    result: list[dict[int, tuple[int, float, float]]] = [{} for _ in buckets]
    for row in found.collect():  # at most 2 ** bits rows per bucket
        result[row["bucket"]][row["part"]] = (row["n"], row["low"], row["high"])
    return result


def _narrow(bucket: _Bucket, parts: dict[int, tuple[int, float, float]], shift: int, known: dict[tuple[str, int], float], base: int) -> list[tuple[_Bucket, int]]:
    """Notes the values of ranks that are certain and returns the parts that hold the others, with the ranks before them."""
    left: list[tuple[_Bucket, int]] = []
    before = 0
    for part in sorted(parts):
        n, low, high = parts[part]
        ranks = {r for r in bucket.ranks if before <= r < before + n}
        if low == high:
            known |= {(bucket.column, base + r): low for r in ranks}
        elif ranks:
            left.append((_Bucket(bucket.column, shift, part, n, {r - before for r in ranks}), base + before))
        before += n
    return left


def _values_at(df: DataFrame, columns: list[str], wanted, bits: int) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """Number of values per column, and the value at each rank that ``wanted(column, number)`` names."""
    whole = [_Bucket(c, 64, None, None, set()) for c in dict.fromkeys(columns)]
    sizes: dict[str, int] = {}
    known: dict[tuple[str, int], float] = {}
    pending: list[tuple[_Bucket, int]] = []
    for bucket, parts in zip(whole, _counts(df, whole, bits)):
        sizes[bucket.column] = sum(n for n, _, _ in parts.values())
        bucket.ranks = set(wanted(bucket.column, sizes[bucket.column]))
        pending += _narrow(bucket, parts, bucket.next_shift(bits), known, 0)
    while pending:
        buckets = [b for b, _ in pending]
        narrowed: list[tuple[_Bucket, int]] = []
        for (bucket, base), parts in zip(pending, _counts(df, buckets, bits)):
            narrowed += _narrow(bucket, parts, bucket.next_shift(bits), known, base)
        pending = narrowed
    return sizes, known


def order_statistic(df: DataFrame, column: str, rank: int, bits: int = LEVEL_BITS) -> float:
    """The value at ``rank`` (from 0) among the values of ``column``; null and NaN are no values."""
    sizes, known = _values_at(df, [column], lambda _, n: {rank} if 0 <= rank < n else set(), bits)
    if (column, rank) not in known:
        raise ValueError(f"rank {rank} is outside the {sizes[column]} values of {column}")
    return known[column, rank]


def exact_quantiles(df: DataFrame, wanted: list[tuple[str, float]], bits: int = LEVEL_BITS) -> list[float | None]:
    """Quantiles (column, share) with linear interpolation between order statistics, missing values skipped; None where
    a column has no values.

    All ranks of all columns are searched in the same passes, six at most with the default bits, and each pass is an
    aggregate with map-side counts, so neither a hot value nor a long table is held in one place. ``df`` is read once
    per pass: pass a stored table.
    """
    shares: dict[str, list[float]] = {}
    for column, q in wanted:
        shares.setdefault(column, []).append(q)

    def ranks(column: str, n: int) -> set[int]:
        places = [(n - 1) * q for q in shares[column]] if n else []
        return {math.floor(p) for p in places} | {min(math.floor(p) + 1, n - 1) for p in places}

    sizes, known = _values_at(df, list(shares), ranks, bits)
    found: list[float | None] = []
    for column, q in wanted:
        n = sizes[column]
        if not n:
            found.append(None)
            continue
        place = (n - 1) * q
        lower = known[column, math.floor(place)]
        upper = known[column, min(math.floor(place) + 1, n - 1)]
        found.append(lower if place == math.floor(place) else lower + (upper - lower) * (place - math.floor(place)))
    return found


def exact_quantile(df: DataFrame, column: str, q: float, bits: int = LEVEL_BITS) -> float | None:
    return exact_quantiles(df, [(column, q)], bits)[0]
