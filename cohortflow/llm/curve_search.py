"""Approximate nearest neighbours by inner product on shifted space-filling curves.

Vectors get one more component that gives all the same norm, so the largest inner product is the smallest angle. Each
of ``CURVES`` curves projects them on random directions, shifts the grid by a random offset and takes the Hilbert key
of the cell. Spark sorts each curve by key into range partitions, the blocks; a query is compared with its own block
and the ``reach`` blocks on either side of every curve, and the finds of all curves are merged and ranked by the inner
product of the original vectors in double precision.

``reach`` is measured, not set: for a bounded sample of queries the true neighbours among all rows are found, and the
reach is the smallest that holds the share ``AIM`` of them on some curve. Vectors without any structure need wide
windows, clustered ones narrow.

Equal vectors are one entry with its ``top`` + 1 smallest ids and a key of its own, so copies can't crowd a window.

Defined results: vectors that are null, zero, not finite, of another length than most, or without id take no part;
ties go to the smaller id; fewer candidates than ``top`` are all returned; an id that stands on several rows is a
candidate with each distinct vector; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.vectors import directions, keyed, matrix, usable
from cohortflow.session import materialize

TOP = 20
CURVES, DIMENSIONS, BITS = 8, 8, 7
#: Vectors per block; bounds of the samples that fit the grid and the reach; share of true neighbours to reach.
BLOCK, GRID_ROWS, REACH_QUERIES, AIM = 2048, 4096, 256, 0.96
SEED = 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of grid coordinates: the axes are turned back level by level, then Gray-coded."""
    axes = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for k in range(len(axes)):
            turned = (axes[k] & bit) != 0
            swap = np.where(turned, 0, (axes[0] ^ axes[k]) & below)
            axes[0] = axes[0] ^ np.where(turned, below, swap)
            axes[k] = axes[k] ^ swap
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    flips = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((axes[-1] >> level) & 1 != 0, (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flips) >> level) & 1)
    return key


class Curves:
    """Projections, scales and shifts of all curves."""

    def __init__(self, length: int, norm: float, sample: np.ndarray):
        self.norm = norm
        dims = min(DIMENSIONS, length + 1)
        draw = np.random.default_rng(SEED)
        self.axes = [directions(SEED + 1 + c, dims, length + 1) for c in range(CURVES)]
        self.shifts = [draw.uniform(0, 0.25, size=dims) for _ in range(CURVES)]
        spread = [self._lifted(sample) @ a.T for a in self.axes] if len(sample) else [np.zeros((1, dims))] * CURVES
        self.middle = [s.mean(axis=0) for s in spread]
        self.scale = [np.maximum(s.std(axis=0), 1e-9) for s in spread]

    def _lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        if query:
            return np.hstack([vectors / size, np.zeros((len(vectors), 1))])
        return np.hstack([vectors, np.sqrt(np.maximum(self.norm**2 - size**2, 0))]) / self.norm

    def keys(self, vectors: np.ndarray, query: bool) -> list[np.ndarray]:
        lifted = self._lifted(vectors, query)
        result = []
        for axes, shift, middle, scale in zip(self.axes, self.shifts, self.middle, self.scale):
            place = ((lifted @ axes.T - middle) / scale + 3.5) / 7 * 0.75 + shift
            result.append(hilbert_keys(np.clip((place * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS))
        return result


def _best(query: np.ndarray, reps: np.ndarray, scores: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its ``top`` best distinct reps, best first, ties to the smaller."""
    order = np.lexsort((reps, -scores, query))
    query, reps, scores = query[order], reps[order], scores[order]
    for q in np.unique(query):
        low, high = np.searchsorted(query, [q, q + 1])
        _, first = np.unique(reps[low:high], return_index=True)
        first = low + np.sort(first)[:top]
        yield q, reps[first], scores[first]


def _finds(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]), pa.int32())
    flat = lambda k, kind: pa.array(np.concatenate([r[k] for r in rows]) if rows else [], kind)
    return pa.table(
        {
            "query": pa.array([r[0] for r in rows], pa.int64()),
            "reps": pa.ListArray.from_arrays(offsets, flat(1, pa.int64())),
            "scores": pa.ListArray.from_arrays(offsets, flat(2, pa.float64())),
        }
    )


FINDS = "query long, reps array<long>, scores array<double>"


def _scored(queries: np.ndarray, asked: np.ndarray, reps: np.ndarray, vectors: np.ndarray, top: int) -> pa.Table:
    rows = []
    for low in range(0, len(queries), 512):
        scores = asked[low : low + 512] @ vectors.T
        if scores.shape[1] > 2 * top:
            # All that reach the top-th best score, so that ties are not cut by chance.
            bar = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
        else:
            bar = np.full((len(scores), 1), -np.inf)
        for k in range(len(scores)):
            here = np.flatnonzero(scores[k] >= bar[k])
            best = here[np.lexsort((reps[here], -scores[k][here]))][:top]
            rows.append((int(queries[low + k]), reps[best], scores[k][best]))
    return _finds(rows)


def _merged(finds: DataFrame, top: int) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        sizes = table["reps"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        query = np.repeat(table["query"].to_numpy(), sizes)
        reps, scores = (table[c].combine_chunks().flatten().to_numpy() for c in ("reps", "scores"))
        return _finds(list(_best(query, reps, scores, top)))

    # Some queries per group: each has at most ``top`` finds per block that it met.
    return finds.withColumn("slot", F.floor(F.col("query") / 1024)).groupBy("slot").applyInArrow(lambda t: merge(t), FINDS)


def nearest(rows: DataFrame, asks: Column, key: str, vector: str, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows to each row where ``asks`` holds, itself left out."""
    spark = rows.sparkSession
    clean, length = usable(rows, key, vector)
    entries = materialize(keyed(_entries(clean, top + 1), "least"), "curve-entries")
    asking = rows.where(asks).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL")
    asking = asking.where(F.size("v") == length).distinct().join(entries.select("v", "rep"), "v")
    asking = materialize(asking.select(F.col("id").alias("query_id"), "rep", "v"), "curve-queries")
    asked = asking.dropDuplicates(["rep"]).select("rep", "v")

    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    total, norm = entries.agg(F.count("*"), F.coalesce(F.max(size), F.lit(1.0))).first()
    sample = entries.orderBy(F.xxhash64("least"), "rep").limit(GRID_ROWS).select("v").toArrow()
    curves = Curves(length, norm, matrix(sample["v"], length) if sample.num_rows else np.zeros((0, length)))
    shared = spark.sparkContext.broadcast(curves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("v"), length)
            is_query = batch.column("is_query")
            asks_ = is_query.to_numpy(zero_copy_only=False)
            keys = np.zeros((CURVES, len(vectors)), np.int64)
            for kind in (False, True):
                chosen = asks_ == kind
                if chosen.any():
                    keys[:, chosen] = shared.value.keys(vectors[chosen], kind)
            for curve, key_ in enumerate(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), curve, np.int32)), pa.array(key_), batch.column("rep"), is_query, batch.column("v")],
                    ["curve", "key", "rep", "is_query", "v"],
                )

    kind = entries.schema["v"].dataType.simpleString()
    marked = entries.select("rep", "v", F.lit(False).alias("is_query")).union(asked.select("rep", "v", F.lit(True)))
    placed = marked.mapInArrow(place, f"curve int, key long, rep long, is_query boolean, v {kind}")
    placed = placed.repartitionByRange(max(1, math.ceil(CURVES * total / BLOCK)), "curve", "key", "rep")
    placed = materialize(placed.withColumn("block", F.spark_partition_id()), "curve-blocks")
    reach = _reach(placed, entries, asked, length, top)

    near = placed.where("is_query").withColumn("block", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)))
    held = placed.where("not is_query")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _finds([])
        return _scored(
            left["rep"].to_numpy(), matrix(left["v"], length), right["rep"].to_numpy(), matrix(right["v"], length), top + 1
        )

    pairs = near.select("curve", "block", "rep", "v").groupBy("curve", "block").cogroup(held.select("curve", "block", "rep", "v").groupBy("curve", "block"))
    finds = materialize(pairs.applyInArrow(lambda a, b: compare(a, b), FINDS), "curve-finds")
    best = _merged(finds, top + 1)
    flat = best.select("query", F.explode(F.arrays_zip("reps", "scores")).alias("f")).select("query", "f.*")
    named = flat.join(entries.select(F.col("rep").alias("reps"), "ids"), "reps").select("query", "scores", F.explode("ids").alias("vec_id"))
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asking.select("query_id", F.col("rep").alias("query"))
        .join(named, "query")
        .where("query_id <> vec_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("scores").alias("score"))
        .withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def _entries(clean: DataFrame, kept: int) -> DataFrame:
    """(v, least, ids): each distinct vector with its smallest ids; a vector with many copies is thinned out in parts first."""
    rows = clean.distinct()
    for keys in (["v", F.pmod("id", F.lit(64))], ["v"]):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("n") <= kept)
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", F.col("ids")[0].alias("least"), "ids")


def _reach(placed: DataFrame, entries: DataFrame, asked: DataFrame, length: int, top: int) -> int:
    """Blocks to either side that hold the share ``AIM`` of the sample's true neighbours on some curve."""
    sample = asked.orderBy(F.xxhash64("rep"), "rep").limit(REACH_QUERIES).toArrow()
    if not sample.num_rows:
        return 0
    queries, vectors = sample["rep"].to_numpy(), matrix(sample["v"], length)
    shared = entries.sparkSession.sparkContext.broadcast((queries, vectors))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                found = _scored(*shared.value, part.column("rep").to_numpy(), matrix(part.column("v"), length), top + 1)
                yield from found.to_batches()

    true = _merged(entries.select("rep", "v").mapInArrow(compare, FINDS), top + 1)
    pairs = true.select("query", F.explode("reps").alias("rep"))
    pairs = materialize(pairs, "curve-pairs")
    # Pairs and places of the sample are small: REACH_QUERIES times ``top`` + 1, and times CURVES.
    here = placed.where("is_query").join(F.broadcast(pairs.select(F.col("query").alias("rep")).distinct()), "rep", "left_semi")
    here = here.select(F.col("rep").alias("query"), "curve", F.col("block").alias("from"))
    there = placed.where("not is_query").select("rep", "curve", "block").join(F.broadcast(pairs), "rep")
    away = there.join(F.broadcast(here), ["query", "curve"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("from") - F.col("block"))).alias("d"))
    return int(away.agg(F.expr(f"percentile_disc({AIM}) within group (order by d)")).first()[0] or 0)
