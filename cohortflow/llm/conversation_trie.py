"""The prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Peeling goes down from the greatest depth: the conversations that end at a
depth join the nodes that survive from below it, equal prefixes merge (members, children, leaves and saved bytes add up,
the smallest id stays), each merged node is a row of the result, its last turn is stripped, and what is left are partial
nodes one turn higher. So nodes are found and aggregated at once.

* Equal conversations are one row with a count before the peeling starts.
* A prefix is named by 128 bits: the xor of a hash of place and turn over its turns. Xor can be taken in parts, so the
  turns of a conversation are numbered by a range sort and hashed in pieces, and no task holds a whole conversation.
* Depths are peeled in bands. What lies under one prefix at the low end of a band is independent of the rest: such groups
  are peeled in a task, many in a bin, as long as a group has at most ``GROUP`` turns. Larger ones are peeled in half
  bands, down to single depths, and one depth is an aggregate by prefix with map-side sums.
* The ids that end at a node are hashed from a sorted stream.

Defined results: rows without conv_id take no part; a null role or text is empty; turns of one conversation with equal
turn are ordered by md5 of role and text, repeated rows count as turns of their own; a null turn comes first; other columns
do not matter; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import mix
from cohortflow.session import lookup_side, materialize

#: Turns of a group, and of a bin of groups, that a task peels; rows per block of a conversation in joins.
GROUP, BIN, BLOCK = 1 << 15, 1 << 15, 4096
#: Children from which on a node's id is sent to them by broadcast.
HOT_PARENT = 100_000
#: Depths at which bands end, and the width of all bands beyond them.
EDGES, WIDE = [0, 1, 8, 32, 128, 512, 2048, 8192, 32768], 65536
#: Rebuilding: conversations by fives share a base, of which up to eight turns are taken.
FAMILY, HEADS = 5, 9
_PLACE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, d, mark, size): each turn's place in its conversation from 1, md5 of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(named).alias("mark"), F.octet_length(text).cast("long").alias("size")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("mark")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "turns").withColumn("part", F.shiftright("at", 33))
    # Only the first conversation of a range partition goes on from the one before: at most one row per partition.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    carried = sizes.select("conv_id", "part", F.sum("n").over(earlier).alias("carried")).where("carried > 0")
    within = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("at"))
    found = placed.withColumn("within", within).join(F.broadcast(carried), ["conv_id", "part"], "left")
    return materialize(found.select("conv_id", (F.col("within") + F.coalesce("carried", F.lit(0))).cast("long").alias("d"), "mark", "size"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of all rebuilt conversations, as ``turns``, and (conv_id, turns) of each.

    A conversation begins with the first h turns of its base, conv_id - conv_id % 5, and goes on with its own after the
    first h; h is the crc32 of its id modulo 9.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    members = (
        own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
        .join(base, "base", "left")
        .withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0))))
        .withColumn("turns", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    )
    members = materialize(members.select("conv_id", "base", "own", "h", "head", "turns"), "members")
    first = turns.where(F.col("d") < HEADS).withColumnRenamed("conv_id", "base")
    heads = first.join(members.select("conv_id", "base", "h"), "base").where("d <= h").select("conv_id", "d", "mark", "size")
    # A long conversation is joined by blocks.
    blocks = members.select("conv_id", "h", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(own - 1) div {BLOCK}"))).alias("block"))
    tails = turns.withColumn("block", F.expr(f"(d - 1) div {BLOCK}")).join(blocks, ["conv_id", "block"]).where("d > h")
    tails = tails.select("conv_id", (F.col("d") - F.col("h") + F.col("head")).alias("d"), "mark", "size")
    return heads.unionByName(tails), members.select("conv_id", "turns")


def band_of(depth: Column) -> Column:
    steps = reduce(lambda a, b: a + b, [(depth > e).cast("long") for e in EDGES])
    return steps - 1 + F.floor(F.greatest(depth - EDGES[-1] - 1, F.lit(0)) / WIDE).cast("long")


def band_edges(band: int) -> tuple[int, int]:
    last = len(EDGES) - 1
    if band < last:
        return EDGES[band], EDGES[band + 1]
    return EDGES[-1] + (band - last) * WIDE, EDGES[-1] + (band - last + 1) * WIDE


def prefix_pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, band, b1, b2, k1, k2, sizes): the prefix before a band and, per turn in it, prefix and bytes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("turns")
            ends = np.cumsum(lists.value_lengths().to_numpy())
            rows = lists.flatten()
            marks = np.frombuffer(bytes.fromhex("".join(rows.field("mark").to_pylist())), np.uint64).reshape(-1, 2)
            places = rows.field("d").to_numpy().astype(np.uint64)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            columns, totals = [], []
            for lane in (0, 1):
                steps = np.bitwise_xor.accumulate(mix(marks[:, lane] ^ mix(places * _PLACE[lane])))
                before = np.concatenate([[np.uint64(0)], steps[ends[:-1] - 1]])
                local = (steps ^ np.repeat(before, np.diff(ends, prepend=0))).view(np.int64)
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(local)))
                totals.append(pa.array(local[ends - 1]))
            sizes = pa.ListArray.from_arrays(offsets, rows.field("size"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("band"), *columns, sizes, *totals], ["conv_id", "band", "l1", "l2", "sizes", "t1", "t2"]
            )

    pieces = turns.groupBy("conv_id", band_of(F.col("d")).alias("band")).agg(F.array_sort(F.collect_list(F.struct("d", "mark", "size"))).alias("turns"))
    pieces = pieces.mapInArrow(hashed, "conv_id long, band long, l1 array<long>, l2 array<long>, sizes array<long>, t1 long, t2 long")
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    pieces = materialize(pieces, "pieces-local")
    before = pieces.select("*", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)])

    def whole(lane: int) -> Column:
        return F.transform(f"l{lane}", lambda x: x.bitwiseXOR(F.col(f"b{lane}"))).alias(f"k{lane}")

    return materialize(before.select("conv_id", "band", "b1", "b2", whole(1), whole(2), "sizes"), "pieces")


STATE = ["rep", "depth", "n", "children", "leaves", "saved"]
NODE = ["k1", "k2", "depth", "p1", "p2", "rep", "n", "children", "leaves", "saved"]


def peel(table: pa.Table, low: int) -> pa.Table:
    """Peels the partial nodes of ``table`` down to ``low``: rows with ``done`` are nodes, the others partial nodes at ``low``.

    Lists begin with the turn above ``low``. A carrier is the row of the smallest member, on whose path a node goes on.
    """
    table = table.combine_chunks()
    number = {c: table[c].to_numpy() for c in [*STATE, "g1", "g2"]}
    lists = {c: table[c].chunk(0) for c in ("k1", "k2", "sizes")}
    flat = {c: v.flatten().to_numpy() for c, v in lists.items()}
    lengths = lists["k1"].value_lengths().to_numpy()
    start = np.cumsum(lengths) - lengths - low - 1
    given = np.stack([number[c] for c in ("n", "children", "leaves", "saved")])
    by_depth = np.argsort(-number["depth"], kind="stable")
    carriers, values, taken, nodes = np.zeros(0, np.int64), np.zeros((4, 0), np.int64), 0, []
    depth = int(number["depth"].max())
    while depth > low:
        stop = int(np.searchsorted(-number["depth"][by_depth], -depth, side="right"))
        ended = by_depth[taken:stop]
        taken = stop
        rows, values = np.concatenate([carriers, ended]), np.concatenate([values, given[:, ended]], axis=1)
        at = start[rows] + depth
        order = np.lexsort((number["rep"][rows], flat["k2"][at], flat["k1"][at]))
        rows, at, values = rows[order], at[order], values[:, order]
        k1, k2 = flat["k1"][at], flat["k2"][at]
        first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        n, children, leaves, saved = np.add.reduceat(values, first, axis=1)
        carriers, at = rows[first], at[first]
        leaves = np.where(children == 0, 1, leaves)
        saved = saved + (n - 1) * flat["sizes"][at]
        p1, p2 = ((number[g][carriers] if depth == low + 1 else flat[k][at - 1]) for g, k in (("g1", "k1"), ("g2", "k2")))
        nodes.append([k1[first], k2[first], np.full(len(first), depth), p1, p2, number["rep"][carriers], n, children, leaves, saved])
        values = np.stack([n, np.ones_like(n), leaves, saved])
        depth -= 1
    n, children, leaves, saved = values
    nothing = np.zeros(len(carriers), np.int64)
    rest = [nothing, nothing, nothing + low, nothing, nothing, number["rep"][carriers], n, children, leaves, saved]
    columns = [np.concatenate(c) for c in zip(*nodes, rest)]
    done = np.ones(len(columns[0]), bool)
    done[len(done) - len(carriers) :] = False
    return pa.table(dict(zip(NODE, columns)) | {"done": done})


class Peeling:
    """The rounds of one trie: ``nodes`` collects the written tables of finished nodes."""

    def __init__(self, pieces: DataFrame):
        self.pieces = pieces
        self.nodes: list[DataFrame] = []

    def _on_paths(self, state: DataFrame, band: int, low: int, high: int) -> DataFrame:
        """``state`` with prefix ``g1``, ``g2`` at ``low`` and the lists of what lies above it, up to ``high``."""
        start = band_edges(band)[0]
        paths = self.pieces.where(F.col("band") == band).withColumnRenamed("conv_id", "rep")
        at = low - start
        # Also evaluated for paths that end before, as projections move below the join: null there.
        prefix = [(F.col(f"b{i}") if not at else F.get(f"k{i}", F.lit(at - 1))).alias(f"g{i}") for i in (1, 2)]
        lists = [F.slice(c, at + 1, high - low).alias(c) for c in ("k1", "k2", "sizes")]
        return state.join(paths, "rep").select(*STATE, *prefix, *lists)

    def one_depth(self, state: DataFrame, band: int, low: int) -> DataFrame:
        """One depth as an aggregate by prefix; partial nodes at ``low``."""
        rows = self._on_paths(state, band, low, low + 1)
        merged = rows.groupBy(F.get("k1", F.lit(0)).alias("k1"), F.get("k2", F.lit(0)).alias("k2")).agg(
            F.min("rep").alias("rep"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
            F.first("g1").alias("p1"), F.first("g2").alias("p2"), F.first(F.get("sizes", F.lit(0))).alias("size"),
        )
        nodes = merged.withColumns(
            {
                "depth": F.lit(low + 1).cast("long"),
                "leaves": F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")),
                "saved": F.col("saved") + (F.col("n") - 1) * F.col("size"),
            }
        )
        nodes = materialize(nodes.select(NODE), "trie-nodes")
        self.nodes.append(nodes)
        return nodes.withColumns({"depth": F.lit(low).cast("long"), "children": F.lit(1).cast("long")}).select(STATE)

    def down(self, state: DataFrame, band: int, low: int, high: int) -> DataFrame:
        """Peels written partial nodes of depths (low, high] and returns those at ``low``."""
        if high - low == 1:
            return self.one_depth(state, band, low)
        rows = self._on_paths(state, band, low, high)
        groups = rows.groupBy("g1", "g2").agg(F.sum(F.col("depth") - low).alias("turns"))
        groups = materialize(groups, "trie-groups")
        total, largest = groups.agg(F.coalesce(F.sum("turns"), F.lit(0)), F.coalesce(F.max("turns"), F.lit(0))).first()
        small, rest = rows, None
        if largest > GROUP:
            # At most one row per GROUP turns.
            large = lookup_side(groups.where(F.col("turns") > GROUP).select("g1", "g2"))
            small = rows.join(large, ["g1", "g2"], "left_anti")
            wide = materialize(rows.join(large, ["g1", "g2"], "left_semi").select(STATE), "trie-wide")
            middle = (low + high) // 2
            upper = self.down(wide.where(F.col("depth") > middle), band, middle, high)
            rest = self.down(materialize(wide.where(F.col("depth") <= middle).unionByName(upper), "trie-state"), band, low, middle)
        bins = max(1, -(-int(total) // BIN))
        schema = ", ".join(f"{c} long" for c in NODE) + ", done boolean"
        binned = small.withColumn("bin", F.pmod(F.xxhash64("g1", "g2"), F.lit(bins))).groupBy("bin")
        peeled = materialize(binned.applyInArrow(lambda table: peel(table.drop_columns(["bin"]), low), schema), "trie-peeled")
        self.nodes.append(peeled.where("done").select(NODE))
        left = peeled.where("NOT done").select(STATE)
        return left if rest is None else left.unionByName(rest)


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the digest of the sorted ids of each end node, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
            if not len(ids):
                continue
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            rows = []
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                here, joined = (int(k1[low]), int(k2[low])), ",".join(map(str, ids[low:high].tolist())).encode()
                if here == at:
                    digest.update(b"," + joined)
                    continue
                if at is not None:
                    rows.append((*at, digest.hexdigest()))
                at, digest = here, hashlib.sha256(joined)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k1", "k2", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, digest.hexdigest())], ["k1", "k2", "ends_sha256"])

    sorted_ids = ends.select("k1", "k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return sorted_ids.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the smallest member of each node's parent; a parent of very many is sent to them all."""
    parents = nodes.where("children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"), "children")
    keys = ["p1", "p2", "depth"]
    hot = parents.where(F.col("children") > HOT_PARENT).drop("children")
    if hot.isEmpty():
        return nodes.join(parents.drop("children"), keys, "left")
    hot = lookup_side(hot)  # at most one row per HOT_PARENT nodes
    return nodes.join(hot, keys).unionByName(nodes.join(hot, keys, "left_anti").join(parents.drop("children"), keys, "left"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie of the conversations ``members`` (conv_id, turns), whose turns are (conv_id, d, mark, size)."""
    pieces = prefix_pieces(turns)
    last = members.where("turns > 0").withColumn("band", band_of(F.col("turns"))).join(pieces, ["conv_id", "band"])
    ends = last.select("conv_id", F.col("turns").alias("depth"), F.element_at("k1", -1).alias("k1"), F.element_at("k2", -1).alias("k2"))
    nothing = F.lit(0).cast("long")
    ends = ends.unionByName(members.where("turns = 0").select("conv_id", F.col("turns").alias("depth"), nothing.alias("k1"), nothing.alias("k2")))
    ends = materialize(ends, "trie-ends")
    ended = ends.groupBy("k1", "k2", "depth").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    ended = materialize(ended.withColumns({c: nothing for c in ("children", "leaves", "saved")}).select(STATE), "trie-ended")
    top = pieces.agg(F.max("band")).first()[0]
    peeling, state = Peeling(pieces), ended.limit(0)
    for band in range(top if top is not None else -1, -1, -1):
        low, high = band_edges(band)
        state = materialize(state.unionByName(ended.where((F.col("depth") > low) & (F.col("depth") <= high))), "trie-state")
        state = peeling.down(state, band, low, high)
    root = state.unionByName(ended.where("depth = 0")).groupBy("depth").agg(F.min("rep").alias("rep"), *[F.sum(c).alias(c) for c in STATE[2:]])
    root = root.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")))
    root = root.select(*[(F.col(c) if c in STATE else (nothing if c in ("k1", "k2") else F.lit(None).cast("long"))).alias(c) for c in NODE])
    nodes = materialize(reduce(DataFrame.unionByName, [*peeling.nodes, root]), "trie")
    found = _with_parents(nodes).join(end_digests(ends).withColumnRenamed("k1", "e1").withColumnRenamed("k2", "e2"), (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    return found.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
    )
