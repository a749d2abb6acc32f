"""Pieces that several operators share: tables, word expressions, Arrow batches and numpy hashing of text."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: code points other than space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def ascii_lower(column) -> Column:
    """Lower case for A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; sizes the number of shards."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def shard_count(total_bytes: float, bytes_per_shard: int) -> int:
    return max(1, math.ceil(total_bytes / bytes_per_shard))


def text_steps(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _offsets(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and the offsets of each; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    ends = _offsets(column)
    values = column.buffers()[2]
    whole = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all bits of its input."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX[0]
    values ^= values >> np.uint64(27)
    values = values * _MIX[1]
    values ^= values >> np.uint64(31)
    return values


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, size: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < size:
        base = np.full(max(size, STEP_BYTES + 1), _MULTIPLIER if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        known = _powers[kind] = np.multiply.accumulate(base)
    return known


def running_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any stretch of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power_table("up", len(data) + 1)[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, stop); equal bytes give equal hashes."""
    return mix((sums[stops] - sums[starts]) * _power_table("down", len(sums))[starts])


def dealt(number: int, shards: int) -> int:
    """The shard of a batch's own rows. Batch numbers are multiples of a power of two, so they are mixed first."""
    return int((int(mix(np.array([number + 1], np.uint64))[0]) >> 32) * shards >> 32)


class Words:
    """The words of a slice of texts: byte spans, the text that each belongs to, and hashes of their lower-cased bytes."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = text_buffer(column)
        self.data = _LOWER[raw]
        self.texts = len(self.offsets) - 1
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        bounds = self.offsets[1:-1]
        before[bounds[bounds < len(raw)]] = False
        after[bounds[bounds > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.stops = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, and the end
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(self.texts), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(running_hash(self.data), self.starts, self.stops)


def with_text(docs: DataFrame, text: str, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Columns ``row`` (a struct of the columns to keep, all by default) and ``_text``; and the DDL type of ``row``."""
    names = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col(text).alias("_text"))
    return packed, packed.schema["row"].dataType.simpleString()


class Groups:
    """Runs of equal (owner, value) pairs in sorted order: where each begins, how long it is, whom it belongs to."""

    def __init__(self, owner: np.ndarray, values: np.ndarray):
        self.order = np.lexsort((values, owner))
        who, what = owner[self.order], values[self.order]
        new = np.ones(len(who), bool)
        new[1:] = (what[1:] != what[:-1]) | (who[1:] != who[:-1])
        self.first = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.first, len(who)))
        self.owner, self.values = who[self.first], what[self.first]
