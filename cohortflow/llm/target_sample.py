"""Target-distribution importance resampling with an exact cutoff by weighted median of medians.

1. Features of a text are its words and neighbouring word pairs, hashed into buckets by crc32. Their counts in the raw
   and in the target texts give each bucket a gain, the log ratio of the two shares: one array of fixed size.
2. A text's weight is the mean gain of its features, from that array. Gumbel noise drawn from the id makes taking the
   highest scores a draw without replacement in proportion to exp(weight).
3. The last score that is drawn is found without a sort: every partition reports the median of the keys that are left
   in it, the median of these weighted by how many are left is the pivot, and at least a quarter of all keys lies on
   either side, so each round discards the pivot's losing side. One row per partition reaches the driver.
4. Only the winners are range-sorted and numbered.

Keys are unique: score, id, a hash of the text, a number that is written with the scores.

Defined results: a null or empty text has no features, weight 0 and too few words to be drawn; a null id draws its noise
as the empty text and stands behind all ids in a tie; rows with equal id and score are ordered by text; repeated rows are
drawn one by one; without target texts all gains follow from the added one per bucket; other columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import _LOWER, text_buffer, text_steps, with_text
from cohortflow.session import materialize

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Added to each bucket; gains are in thousandths.
ADDED, SCALE = 1, 1000
#: Bytes of a word that numpy reads step by step; the rest of a longer one goes through zlib.
STEPS = 48
_SPACE = np.uint32(32)


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> np.uint32(1)) ^ np.uint32(0xEDB88320), values >> np.uint32(1))
    return values


_CRC = _crc_table()


def crc_states(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Running crc32 states (inverted sums) after the stretches [start, stop) of ``data``, from ``states``."""
    sizes = stops - starts
    order = np.argsort(-sizes, kind="stable")
    sizes, at, now = sizes[order], starts[order], states[order]
    for k in range(min(int(sizes[0]), STEPS) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -k, side="left"))  # those with more than k bytes
        now[:live] = _CRC[(now[:live] ^ data[at[:live] + k]) & np.uint32(255)] ^ (now[:live] >> np.uint32(8))
    for long in range(int(np.searchsorted(-sizes, -STEPS, side="left"))):
        rest = data[at[long] + STEPS : at[long] + sizes[long]].tobytes()
        now[long] = ~np.uint32(zlib.crc32(rest, int(~now[long])))
    found = np.empty_like(now)
    found[order] = now
    return found


class Features:
    """Buckets of all features of a slice of texts and the text that each belongs to."""

    def __init__(self, column: pa.Array, buckets: int):
        raw, offsets = text_buffer(column)
        data = _LOWER[raw]
        self.texts = len(offsets) - 1
        inside = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        bounds = offsets[1:-1]
        before[bounds[bounds < len(raw)]] = False
        after[bounds[bounds > 0] - 1] = False
        starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.words = np.diff(np.searchsorted(starts, offsets))
        owner = np.repeat(np.arange(self.texts), self.words)
        word = crc_states(data, starts, stops, np.full(len(starts), 0xFFFFFFFF, np.uint32))
        first = np.flatnonzero(owner[1:] == owner[:-1])
        spaced = _CRC[(word[first] ^ _SPACE) & np.uint32(255)] ^ (word[first] >> np.uint32(8))
        pair = crc_states(data, starts[first + 1], stops[first + 1], spaced)
        self.buckets = (~np.concatenate([word, pair])) % np.uint32(buckets)
        self.owner = np.concatenate([owner, owner[first]])
        self.sizes = np.maximum(2 * self.words - 1, 0)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts`` per bucket: every task adds up its own, ``buckets`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for step in text_steps(batches, text):
            total += np.bincount(Features(step.column(text), buckets).buckets, minlength=buckets)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], ["bucket", "n"])

    sums = texts.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    result = np.zeros(buckets, np.int64)
    result[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return result


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of each bucket's share in the target to that in the raw texts, one added to each count."""
    size, raw_total, target_total = len(raw), float(raw.sum()), float(target.sum())
    above = [(t + ADDED) * (raw_total + ADDED * size) for t in target.astype(float).tolist()]
    below = [(s + ADDED) * (target_total + ADDED * size) for s in raw.astype(float).tolist()]
    return np.array([math.floor(SCALE * math.log(a / b)) for a, b in zip(above, below)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) as struct ``row`` with n_features, n_words and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    packed, row = with_text(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, "_text"):
            found = Features(step.column("_text"), len(shared.value))
            # Sums of whole numbers, exact below 2 ** 53.
            sums = np.bincount(found.owner, weights=shared.value[found.buckets], minlength=found.texts).astype(np.int64)
            columns = [step.column("row"), pa.array(found.sizes), pa.array(found.words), pa.array(sums // np.maximum(found.sizes, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_features", "n_words", "weight"])

    return packed.mapInArrow(run, f"row {row}, n_features long, n_words long, weight long")


def gumbel(name: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of seed and name."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((bits + 0.5) / 4294967296.0))).cast("long")


#: The order in which rows are drawn; all whole numbers, unique by the last.
KEY = ["neg", "no_id", "id", "tie", "seq"]


def _key(values: tuple) -> Column:
    return F.struct(*[F.lit(int(v)).cast("long").alias(n) for n, v in zip(KEY, values)])


def _medians(left: DataFrame, pivot: tuple | None) -> list[tuple[int, int, tuple]]:
    """(side, size, median) of the keys before (0), or after (1), the pivot, for each partition that holds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(n).to_numpy() for n in KEY]) for b in batches if b.num_rows]
        keys = np.concatenate(held, axis=1) if held else np.zeros((len(KEY), 0), np.int64)
        after = np.ones(keys.shape[1], bool)
        if pivot is not None:
            tied = np.ones(keys.shape[1], bool)
            after[:] = False
            equal = tied
            for column, value in zip(keys, pivot):
                after |= equal & (column > value)
                equal = equal & (column == value)
            keys, after = keys[:, ~equal], after[~equal]
        rows = []
        for side in (0, 1):
            own = keys[:, after == side]
            if own.shape[1]:
                middle = np.lexsort(own[::-1])[(own.shape[1] - 1) // 2]
                rows.append({"side": side, "size": own.shape[1], **{n: int(v) for n, v in zip(KEY, own[:, middle])}})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("side", pa.int64()), ("size", pa.int64()), *((n, pa.int64()) for n in KEY)]))

    found = left.select(*KEY).mapInArrow(run, "side long, size long, " + ", ".join(f"{n} long" for n in KEY)).collect()
    return [(r["side"], r["size"], tuple(r[n] for n in KEY)) for r in found]


def _weighted_median(medians: list[tuple[int, tuple]]) -> tuple:
    """The first median up to which partitions with half of all keys report theirs."""
    half, total = sum(size for size, _ in medians) / 2, 0
    for size, median in sorted(medians, key=lambda m: m[1]):
        total += size
        if total >= half:
            return median
    raise ValueError("no keys are left")


def cutoff(keys: DataFrame, rank: int) -> tuple:
    """The key at ``rank`` (from 1) of the written table ``keys``, whose keys are unique."""
    left = keys
    sides = {1: [(size, median) for _, size, median in _medians(left, None)]}
    side = 1
    while True:
        pivot = _weighted_median(sides[side])
        found = _medians(left, pivot)
        sides = {s: [(size, median) for at, size, median in found if at == s] for s in (0, 1)}
        before = sum(size for size, _ in sides[0])
        if rank == before + 1:
            return pivot
        side = 0 if rank <= before else 1
        key = F.struct(*KEY)
        # The first condition repeats what the second says on one column, for the scan.
        if side == 0:
            left = left.where((F.col("neg") <= pivot[0]) & (key < _key(pivot)))
        else:
            left, rank = left.where((F.col("neg") >= pivot[0]) & (key > _key(pivot))), rank - before - 1


def _numbered(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` from 1: a range sort, written with each row's place in its partition, and offsets."""
    placed = winners.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "sample-winners").withColumn("part", F.shiftright("at", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition.
    offsets = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + place + 1).drop("at", "part", "offset")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
    text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
) -> DataFrame:
    """Every row (``keep``, all columns by default, as struct ``row``) with n_features, n_words, weight, score and rank.

    Of the rows with at least ``least_words`` words, the ``percent`` of highest score are drawn and have a rank.
    """
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    names = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("kept"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("_text"))
    found = weighed(packed, gains, "_text", ["kept", "id", "tie"])
    name = F.coalesce(F.col("row.id").cast("string"), F.lit(""))
    scored = found.select(
        F.col("row.kept").alias("row"), "n_features", "n_words", "weight", (F.col("weight") + gumbel(name, seed)).alias("score"),
        F.col("row.id").isNull().cast("long").alias("no_id"), F.coalesce("row.id", F.lit(0)).alias("id"), F.col("row.tie").alias("tie"),
    )
    scored = materialize(scored.withColumns({"neg": -F.col("score"), "seq": F.monotonically_increasing_id()}), "sample-scores")
    eligible = scored.where(F.col("n_words") >= least_words)
    wanted = percent * eligible.count() // 100
    columns = ["row", "n_features", "n_words", "weight", "score", "rank"]
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(columns)
    last = _key(cutoff(eligible.select(*KEY), wanted))
    drawn = (F.col("n_words") >= least_words) & (F.struct(*KEY) <= last)
    left = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return _numbered(scored.where(drawn)).select(columns).unionByName(left.select(columns))
