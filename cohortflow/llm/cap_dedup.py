"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction, and a vector passes it if their cosine is above ``bar``. The directions are a random product
code: the rotated space is cut into parts, each part has a small codebook, and every combination of one word per part
is a filter, so the filters that a vector passes are list-decoded part by part without trying them all. Vectors that
share a filter meet in Spark and their cosine is taken in double precision; a pair that meets often counts once, in
the first filter that both pass. The number of filters follows the number of vectors, so a filter keeps about as many
vectors at any size; a filter with more is cut into blocks that meet pairwise.

How many filters a vector passes is measured, not set: it is raised until the share ``AIM`` of the pairs at the limit
cosine meets, and also of the links that a bounded sample of rows has among all rows. It grows with the table, and it is
a floor for each vector. Where more filters don't get there, as in few dimensions, they are made wider.

Equal vectors are one class with a count. Per filter only sums and local components leave the task, never all pairs.

Defined results: a vector that is null, zero, not finite, of another length than most, or without id links with
nothing and is its own component; equal rows count as different vectors of one class; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import mix
from cohortflow.llm.components import components
from cohortflow.llm.vectors import directions, keyed, matrix, usable
from cohortflow.session import materialize

LEAST_COSINE = 0.95
#: Filters that a vector passes on average, and at least, before they are raised; vectors that pass a filter on average.
PASSED, PASSED_LEAST, PER_FILTER = 12, 6, 16
CODEBOOK = 1024
#: Share of pairs to meet; rows of the sample, links of each, and partners at the limit that are drawn for each.
AIM = 0.995
SAMPLE_ROWS, SAMPLE_LINKS, DRAWN = 256, 16, 8
#: Filters per vector beyond which they are made wider instead; filters in under four dimensions.
MOST_PASSED, FEW_FILTERS = 512, 64
BLOCK = 1024
SEED = 4


class ProductCode:
    """Codebooks per part and the bar; ``decode`` lists the filters of a vector."""

    def __init__(self, length: int, vectors: int, sample: np.ndarray, passed: int = PASSED, least: int = PASSED_LEAST, held: int = PER_FILTER):
        self.least = least
        filters = max(64.0, passed * vectors / held) if length >= 4 else FEW_FILTERS
        # A part of one dimension would have two different words only.
        self.parts = min(max(1, length // 2), max(1, math.ceil(math.log(filters) / math.log(CODEBOOK) - 1e-9), 2))
        self.words = max(4, math.ceil(filters ** (1 / self.parts)))
        self.rotation = directions(SEED, length, length)
        self.cuts = np.linspace(0, length, self.parts + 1).astype(int)
        self.books = [directions(SEED + 1 + k, self.words, b - a) for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]
        self.bar = -np.inf
        share = passed / float(self.words) ** self.parts
        if len(sample):
            # The bar that lets ``passed`` filters through on average, from random filters on the sample.
            draw = np.random.default_rng(SEED).integers(0, self.words, size=(self.parts, 1 << 16))
            scores = sum(s[:, d] for s, d in zip(self._scores(sample), draw))
            self.bar = float(np.quantile(scores, max(0.0, 1 - share)))

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        rotated = unit @ self.rotation.T
        return [rotated[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per vector, the sorted numbers of all filters at or above the bar, or its best ``least`` if more."""
        scores = self._scores(unit)
        best = [s.max(axis=1) for s in scores]
        rest = np.zeros((len(unit), self.parts + 1))
        for k in range(self.parts - 1, -1, -1):
            rest[:, k] = rest[:, k + 1] + best[k]
        result = []
        for row in range(len(unit)):
            bar = min(self.bar, rest[row, 0] - 1e-9)
            while True:
                sums, codes = np.zeros(1), np.zeros(1, np.int64)
                for k in range(self.parts):
                    total = sums[:, None] + scores[k][row][None, :]
                    i, j = np.nonzero(total >= bar - rest[row, k + 1])
                    sums, codes = total[i, j], codes[i] * self.words + j
                if len(codes) >= min(self.least, self.words**self.parts):
                    break
                bar -= 0.05 * max(abs(bar), 0.1)
            if bar < self.bar:
                codes = codes[np.argsort(-sums, kind="stable")[: max(self.least, int((sums >= self.bar).sum()))]]
            result.append(np.sort(codes))
        return result


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _limit_pairs(unit: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at cosine ``least``: of each vector and a step in any direction, or in the direction of another vector."""
    count, length = unit.shape
    if count < 2 or length < 2:
        return []
    draw = np.random.default_rng(SEED)
    first = np.repeat(np.arange(count), DRAWN)
    other = (first + draw.integers(1, count, size=len(first))) % count
    pairs = []
    for step in (draw.normal(size=(len(first), length)), unit[other]):
        step = step - (step * unit[first]).sum(axis=1, keepdims=True) * unit[first]
        size = np.linalg.norm(step, axis=1)
        good = size > 1e-6
        moved = least * unit[first[good]] + math.sqrt(max(0.0, 1 - least**2)) * step[good] / size[good][:, None]
        pairs.append((first[good], moved))
    return pairs


def missed(code: ProductCode, unit: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> int:
    """How many of the pairs, rows of ``unit`` and their partners, pass no filter together."""
    own, (first, moved) = code.decode(unit), pairs
    return sum(not np.isin(own[k], passed, assume_unique=True).any() for k, passed in zip(first, code.decode(moved)))


def fitted_code(length: int, vectors: int, unit: np.ndarray, least: float, links: tuple[np.ndarray, np.ndarray] | None = None) -> ProductCode:
    """The code with the fewest filters per vector at which the share ``AIM`` of all kinds of pairs of the sample meets."""
    pairs = _limit_pairs(unit, least) + ([links] if links else [])
    passed, held = PASSED, PER_FILTER

    def enough(code: ProductCode) -> bool:
        # With a margin, so that the share is not met by the luck of the draw.
        return all((n := missed(code, unit, p)) + 1.64 * math.sqrt(n) <= (1 - AIM) * len(p[0]) for p in pairs)

    while True:
        code = ProductCode(length, vectors, unit, passed, passed, held)
        if passed >= code.words**code.parts or enough(code):
            return code
        if passed < MOST_PASSED:
            passed = math.ceil(passed * 1.25)
        else:
            held *= 2


def _sample_links(classes: DataFrame, reps: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the sample among all classes, at most ``SAMPLE_LINKS`` of each row, by hash: place in it and unit vector."""
    length = unit.shape[1]
    shared = classes.sparkSession.sparkContext.broadcast((reps, unit))
    schema = pa.schema([("asked", pa.int32()), ("hash", pa.int64()), ("u", pa.list_(pa.float64()))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, unit = shared.value
        asked, hashes, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, length))
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                here, rep = _units(matrix(part.column("v"), length)), part.column("rep").to_numpy()
                row, place = np.nonzero((here @ unit.T >= least) & (rep[:, None] != reps[None, :]))
                # Only the first by hash of each asked row are kept, so a crowded one stays small.
                asked = np.concatenate([asked, place])
                hashes = np.concatenate([hashes, mix(rep[row].astype(np.int64).view(np.uint64)).view(np.int64)])
                order = np.lexsort((hashes, asked))
                starts = np.searchsorted(asked[order], asked[order])
                order = order[np.arange(len(order)) - starts < SAMPLE_LINKS]
                old = len(found)
                kept = np.empty((len(order), length))
                kept[order < old] = found[order[order < old]]
                kept[order >= old] = here[row[order[order >= old] - old]]
                asked, hashes, found = asked[order], hashes[order], kept
        offsets = pa.array(np.arange(len(found) + 1) * length, pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array(hashes), lists], schema=schema)

    by_hash = Window.partitionBy("asked").orderBy("hash", "u")
    found = classes.select("rep", "v").mapInArrow(compare, "asked int, hash long, u array<double>")
    found = found.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= SAMPLE_LINKS).select("asked", "u").toArrow()
    if not found.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, length))
    return found["asked"].to_numpy().astype(np.int64), matrix(found["u"], length)


def _local_roots(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name in each one's component under the boolean matrix ``links``."""
    label = names.copy()
    while True:
        before = label.copy()
        for row in np.flatnonzero(links.any(axis=1)):
            label[row] = min(label[row], label[links[row]].min())
        if (label == before).all():
            return label


def _met_before(links: np.ndarray, starts: np.ndarray, flat: np.ndarray, here: int) -> np.ndarray:
    """Which of the ``links`` also share a filter below ``here``; ``flat[starts[k]:starts[k + 1]]`` are the filters of k."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    below = flat < here
    owner, names = owner[below], flat[below]
    names, place, times = np.unique(names, return_inverse=True, return_counts=True)
    # Filters that two of them pass, in portions that bound the memory.
    shared = np.cumsum(times > 1) - 1
    kept = times[place] > 1
    owner, place = owner[kept], shared[place[kept]]
    before = np.zeros_like(links)
    for low in range(0, int((times > 1).sum()), 1024):
        part = (place >= low) & (place < low + 1024)
        held = np.zeros((len(links), 1024), np.float32)
        held[owner[part], place[part] - low] = 1
        before |= held @ held.T > 0
        if before[links].all():
            break
    return before & links


def near_duplicates(rows: DataFrame, key: str, vector: str, least: float = LEAST_COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; ids as long."""
    spark = rows.sparkSession
    clean, length = usable(rows, key, vector)
    classes = clean.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(keyed(classes, "least"), "vector-classes")
    sample = classes.orderBy(F.xxhash64("least"), "rep").limit(SAMPLE_ROWS).select("rep", "v").toArrow()
    unit = _units(matrix(sample["v"], length)) if sample.num_rows else np.zeros((0, length))
    links = _sample_links(classes, sample["rep"].to_numpy(), unit, least) if len(unit) else None
    code = fitted_code(length, classes.count(), unit, least, links)
    shared = spark.sparkContext.broadcast(code)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                lists = shared.value.decode(_units(matrix(part.column("v"), length)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("v"), flat], ["rep", "copies", "v", "passed"])

    kind = classes.schema["v"].dataType.simpleString()
    # Many small tasks for the decoding: it is the costly part of a narrow table.
    spread = classes.repartition(max(8, math.ceil(classes.count() / 8192)), "rep")
    decoded = spread.mapInArrow(decode, f"rep long, copies long, v {kind}, passed array<long>")
    met = decoded.select("*", F.explode("passed").alias("filter"))
    met = materialize(met, "filter-members")
    crowds = met.groupBy("filter").count().where("count > 1").select("filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    met = met.join(crowds, "filter")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least(F.col("block"), o).alias("low"), F.greatest(F.col("block"), o).alias("high")))
    met = met.withColumn("block", block).withColumn("pair", F.explode(pairs)).select("filter", "pair.*", "block", "rep", "copies", "v", "passed")

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        here, low, high = (k.as_py() for k in key)
        table = table.sort_by("rep")
        block = table["block"].to_numpy()
        unit = _units(matrix(table["v"], length))
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        links = unit @ unit.T >= least
        np.fill_diagonal(links, False)
        if low != high:
            links &= block[:, None] != block[None, :]
        counts = links
        if links.any():
            # A pair counts where no smaller filter is passed by both.
            passed = table["passed"].combine_chunks()
            starts = passed.offsets.to_numpy()
            counts = links & ~_met_before(links, starts - starts[0], passed.flatten().to_numpy(), here)
        linked = np.flatnonzero(links.any(axis=1))
        return pa.table(
            {"rep": rep[linked], "links": (counts @ copies)[linked].astype(np.int64), "root": _local_roots(links, rep)[linked]}
        )

    found = met.groupBy("filter", "low", "high").applyInArrow(verify, "rep long, links long, root long")
    found = materialize(found, "filter-links")
    reached = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    # Keys grow with ids, so the smallest key of a component belongs to its smallest id.
    first = classes.select(F.col("rep").alias("first"), F.col("least").alias("smallest"))
    named = reached.select("node", F.col("component").alias("first")).join(first, "first").select("node", F.col("smallest").alias("component"))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        classes.join(totals, "rep", "left")
        .join(named.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "least").alias("component"))
    )
    every = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    every = every.withColumn("sought", F.when(F.col("id").isNotNull(), F.col("v")))
    joined = every.join(known.withColumnRenamed("v", "known"), F.col("sought") == F.col("known"), "left")
    return joined.select(
        "id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )
