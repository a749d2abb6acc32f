"""Suffix-array dedup: every byte that a 200-byte string covers which also starts anywhere else is removed.

1. Anchors. The smallest hash of 64-byte strings inside a 200-byte string names its anchor. Equal strings have the same
   anchor at the same place, so only strings whose anchor occurs twice can repeat, and neighbouring strings mostly
   share one: counting anchors is a shuffle of a few bytes per hundred of text.
2. Stretches of text whose anchor occurs twice go to shards by anchor. A shard is an index of logarithmically many
   levels. Arriving stretches form a batch, whose suffixes are sorted by their first bytes and then by a fingerprint of
   their first 200, so suffixes with a common start of 200 bytes are neighbours; the batch is merge-scanned against all
   levels for such matches, what is new becomes a level, and levels of equal rank merge into one of the next rank.
   An anchor with more than ``CROWDED`` stretches is not held by one shard: its strings go one by one, as fingerprints,
   to shards by fingerprint, where equal ones meet, once per batch and without their bytes.
3. The marked strings come back as byte ranges per text, are joined, and cut out.

Texts are told apart by their digest: all results depend on a text and the corpus only. Stretches that occur twice
within a task's batch are marked there and sent once, so that a text in many copies, or a passage in many texts, is
a few rows per batch.

Defined results: a null text is empty, and empty and short texts lose nothing; equal rows repeat each other; bytes are
cut anywhere, also inside a character; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import mix, running_hash, shard_count, span_hash, text_buffer, text_bytes, text_steps
from cohortflow.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from cohortflow.session import materialize

LENGTH = 200
GRAM = 64
#: Bytes of text per batch, per shard of anchors and per shard of the index.
BATCH_BYTES, ANCHOR_BYTES, SHARD_BYTES = 4 << 20, 32 << 20, 2 << 20
#: Suffixes that a batch of the index has at least, but for the last one.
BATCH_SUFFIXES = 1 << 16
#: Stretches of an anchor that one shard takes.
CROWDED = 4096
_LOW = np.uint64(0xFFFFFFFF)
MEMBER, ENTRIES, REPEATED = 0, 1, 2
STRETCHES, PRINTS, SETTLED = 0, 1, 2


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Runs:
    """The 200-byte strings of a slice of texts, grouped into runs of neighbours with one anchor.

    Run k holds the strings that start at first[k], ..., last[k] of the bytes ``data``; ``anchor`` is a hash of its
    anchor's bytes and ``owner`` its text.
    """

    def __init__(self, column: pa.Array, length: int = LENGTH):
        self.data, self.offsets = text_buffer(column)
        sizes = np.maximum(np.diff(self.offsets) - length + 1, 0)
        starts = _ranges(self.offsets[:-1], sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if not len(starts):
            self.first = self.last = self.owner = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        grams = np.arange(len(self.data) - GRAM + 1)
        hashes = span_hash(running_hash(self.data), grams, grams + GRAM)
        # The smallest hash in reach, the first of equal ones: half of the bits order, the others hold the place.
        least = (hashes & ~_LOW) | grams.astype(np.uint64)
        reach, width = length - GRAM + 1, 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if reach > width:
            least = np.minimum(least[: -(reach - width)], least[reach - width :])
        anchors = (least[starts] & _LOW).astype(np.int64)
        new = np.flatnonzero((np.diff(anchors, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        self.first = starts[new]
        self.last = starts[np.append(new[1:], len(starts)) - 1]
        # Mixed again: anchors are small hashes, and shards go by the high bits.
        self.anchor = mix(hashes[anchors[new]])
        self.owner = owner[new]


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _dealt(number: int, shards: int) -> int:
    """The shard of a batch's own rows, mixed: numbers are multiples of a power of two."""
    return int(_shards(mix(np.array([number + 1], np.uint64)), shards)[0])


def _numbered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Steps of a task in batches of about ``BATCH_BYTES``, numbered the same when a task is repeated."""
    number, steps, size = TaskContext.get().partitionId() << 24, [], 0
    for step in text_steps(batches, text):
        steps.append(step)
        size += len(text_buffer(step.column(text))[0])
        if size >= BATCH_BYTES:
            yield number, steps
            number, steps, size = number + 1, [], 0
    if steps:
        yield number, steps


def repeated_anchors(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """(digest, anchors, crowded): per distinct text with any, its anchors that occur at two places or more, packed, and
    which of them have more than ``CROWDED`` stretches.

    ``docs`` has text and digest.
    """
    bound = CROWDED
    schema = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("digest", pa.binary()), ("anchors", pa.binary()), ("counts", pa.binary())])
    cells = "shard int, batch long, kind int, digest binary, anchors binary, counts binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, steps in _numbered(batches, "text"):
            rows, every, known = [], [], set()
            for step in steps:
                runs = Runs(step.column("text"), length)
                every.append(runs.anchor)
                cuts = np.searchsorted(runs.owner, np.arange(step.num_rows + 1))
                for digest, low, high in zip(step.column("digest").to_pylist(), cuts, cuts[1:]):
                    if high > low and digest not in known:
                        known.add(digest)
                        cell = pack_sorted(np.unique(runs.anchor[low:high]))
                        rows.append({"shard": _dealt(number, shards), "batch": number, "kind": MEMBER, "digest": digest, "anchors": cell})
            anchors, counts = np.unique(np.concatenate(every), return_counts=True)
            cuts = np.searchsorted(_shards(anchors, shards), np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[k], cuts[k + 1])
                rows.append({"shard": int(k), "batch": number, "kind": ENTRIES, "anchors": pack_sorted(anchors[part]), "counts": pack(counts[part].astype(np.uint32))})
            yield pa.RecordBatch.from_pylist(rows, schema)

    def count(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        entries = table.filter(pa.array(kinds == ENTRIES))
        parts = [unpack_sorted(x, np.uint64) for x in entries["anchors"].to_pylist()]
        back = []
        if parts:
            times = np.concatenate([unpack(x, np.uint32) for x in entries["counts"].to_pylist()])
            place = np.unique(np.concatenate(parts), return_inverse=True)[1]
            total = np.bincount(place, weights=times)
            cuts = np.cumsum([0] + [len(p) for p in parts])
            for batch, part, low, high in zip(entries["batch"].to_pylist(), parts, cuts, cuts[1:]):
                here = total[place[low:high]]
                if (here > 1).any():
                    crowded = pack((here[here > 1] > bound).astype(np.uint8))
                    back.append({"batch": batch, "kind": REPEATED, "anchors": pack_sorted(part[here > 1]), "counts": crowded})
        return pa.concat_tables([table.filter(pa.array(kinds != ENTRIES)).select(schema.names), pa.Table.from_pylist(back, schema)])

    def gather(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        repeated = table.filter(pa.array(kinds == REPEATED))
        again, crowded = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        if repeated.num_rows:
            again = np.concatenate([unpack_sorted(x, np.uint64) for x in repeated["anchors"].to_pylist()])
            crowded = np.concatenate([unpack(x, np.uint8) for x in repeated["counts"].to_pylist()])
            order = np.argsort(again)
            again, crowded = again[order], crowded[order]
        members = table.filter(pa.array(kinds == MEMBER))
        rows = []
        for digest, cell in zip(members["digest"].to_pylist(), members["anchors"].to_pylist()):
            anchors = unpack_sorted(cell, np.uint64)
            anchors = anchors[np.isin(anchors, again, assume_unique=True)]
            if len(anchors):
                rows.append({"digest": digest, "anchors": pack_sorted(anchors), "crowded": pack(crowded[np.searchsorted(again, anchors)])})
        return pa.Table.from_pylist(rows, pa.schema([("digest", pa.binary()), ("anchors", pa.binary()), ("crowded", pa.binary())]))

    counted = docs.mapInArrow(send, cells).groupBy("shard").applyInArrow(lambda t: count(t), cells)
    found = counted.groupBy("batch").applyInArrow(lambda t: gather(t), "digest binary, anchors binary, crowded binary")
    return materialize(found.dropDuplicates(["digest"]), "repeated-anchors")


class LogIndex:
    """Levels of sorted suffixes; ``add`` gives the numbers of all suffixes, old and new, that turn out to repeat.

    A suffix is sorted by its first four bytes and then by the fingerprint of its first ``length`` bytes: a key holds
    the four bytes and the high half of the fingerprint, and equal keys are told apart by the whole fingerprint.
    """

    def __init__(self, length: int = LENGTH):
        self.length = length
        #: (rank, keys, fingerprints, numbers), distinct suffixes in order.
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def _suffix_array(self, data: np.ndarray, starts: np.ndarray, numbers: np.ndarray):
        prints = span_hash(running_hash(data), starts, starts + self.length)
        lead = np.zeros(len(starts), np.uint64)
        for k in range(4):
            lead = (lead << np.uint64(8)) | data[starts + k].astype(np.uint64)
        keys = (lead << np.uint64(32)) | (prints >> np.uint64(32))
        order = np.lexsort((prints, keys))
        return keys[order], prints[order], numbers[order]

    @staticmethod
    def _scan(level, new) -> np.ndarray:
        """For each new suffix the place of its equal in the level, or -1."""
        keys, prints, _ = level
        found = np.full(len(new[0]), -1, np.int64)
        place = np.searchsorted(keys, new[0])
        left = np.flatnonzero(place < len(keys))
        while len(left):
            left = left[keys[place[left]] == new[0][left]]
            equal = prints[place[left]] == new[1][left]
            found[left[equal]] = place[left[equal]]
            left = left[~equal]
            place[left] += 1
            left = left[place[left] < len(keys)]
        return found

    def add(self, data: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """A batch: the suffixes at ``starts`` of ``data``, each with at least ``length`` bytes left."""
        keys, prints, names = self._suffix_array(data, starts, numbers)
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (prints[1:] == prints[:-1])
        hits = [names[same | np.append(same[1:], False)]]
        new = (keys[~same], prints[~same], names[~same])
        for _, *level in self.levels:
            place = self._scan(level, new)
            met = place >= 0
            hits += [new[2][met], level[2][place[met]]]
            new = tuple(x[~met] for x in new)
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, *level = self.levels.pop()
            order = np.argsort(np.concatenate([level[0], new[0]]), kind="stable")  # two sorted parts merge in linear time
            new, rank = tuple(np.concatenate([a, b])[order] for a, b in zip(level, new)), rank + 1
        self.levels.append((rank, *new))
        return np.concatenate(hits)


def _joined(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges that neither overlap nor touch."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def _range_rows(digests: list[bytes], owner: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Table:
    """One row per owner with its joined ranges."""
    order = np.argsort(owner, kind="stable")
    owner, starts, stops = owner[order], starts[order], stops[order]
    cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1) != 0), len(owner))
    rows = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        a, b = _joined(starts[low:high], stops[low:high])
        rows.append({"digest": digests[owner[low]], "ranges": pack(np.concatenate([a, b]).astype(np.int64))})
    return pa.Table.from_pylist(rows, pa.schema([("digest", pa.binary()), ("ranges", pa.binary())]))


def sent_stretches(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """What each shard is told by each batch: stretches, fingerprints of crowded anchors, and what the batch has settled.

    ``docs`` has text, digest, the packed anchors of the text that occur twice, and which of them are crowded.
    """
    schema = pa.schema(
        [("shard", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("digests", pa.list_(pa.binary())), ("owners", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())]
    )
    cells = "shard int, batch long, kind int, digests array<binary>, owners binary, sizes binary, bytes binary"

    def told_apart(number: int, digests: list[bytes], double: set, sums: np.ndarray, owner: np.ndarray, inside: np.ndarray, at: np.ndarray) -> list[dict]:
        """Strings of crowded anchors: those that the batch has twice are settled, the others tell their owner."""
        prints = span_hash(sums, at, at + length)
        order = np.lexsort((inside, owner, prints, _shards(mix(prints), shards)))
        owner, inside, prints = owner[order], inside[order], prints[order]
        new = np.ones(len(order), bool)
        new[1:] = prints[1:] != prints[:-1]
        first = np.flatnonzero(new)
        settled = np.repeat(np.diff(np.append(first, len(order))) > 1, np.diff(np.append(first, len(order))))
        settled |= np.isin(owner, np.fromiter(double, np.int64, len(double)))
        rows = []
        if settled.any():
            cells = _range_rows(digests, owner[settled], inside[settled], inside[settled] + length).to_pylist()
            joined = [unpack(c["ranges"], np.int64).reshape(2, -1) for c in cells]
            place = np.repeat(np.arange(len(cells)), [j.shape[1] for j in joined])
            packed = pack(np.concatenate([place, *np.concatenate(joined, axis=1)]).astype(np.int64))
            rows.append({"shard": _dealt(number, shards), "batch": number, "kind": SETTLED, "digests": [c["digest"] for c in cells], "owners": packed})
        owner, inside = np.where(settled, -1, owner)[first], np.where(settled, -1, inside)[first]
        prints = prints[first]
        cuts = np.searchsorted(_shards(mix(prints), shards), np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            who, place = np.unique(owner[part], return_inverse=True)
            if who[0] < 0:
                who, place = who[1:], place - 1
            packed = pack(np.concatenate([place, inside[part]]).astype(np.int64))
            rows.append(
                {"shard": int(k), "batch": number, "kind": PRINTS, "digests": [digests[w] for w in who], "owners": packed, "bytes": pack_sorted(prints[part])}
            )
        return rows

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, steps in _numbered(batches, "text"):
            digests, known, double = [], {}, set()
            parts: list[tuple[np.ndarray, ...]] = []
            heavy: list[tuple[np.ndarray, ...]] = []
            buffers, base = [], 0
            for step in steps:
                names = step.column("digest").to_pylist()
                runs = Runs(step.column("text"), length)
                fresh = np.zeros(len(names), bool)
                place = np.zeros(len(names), np.int64)
                for k, name in enumerate(names):
                    if name in known:
                        double.add(known[name])
                    else:
                        known[name], fresh[k] = len(digests), True
                        digests.append(name)
                    place[k] = known[name]
                wanted = np.concatenate([unpack_sorted(x, np.uint64) for x in step.column("anchors").to_pylist()])
                crowded = np.concatenate([unpack(x, np.uint8) for x in step.column("crowded").to_pylist()]) > 0
                chosen = fresh[runs.owner] & np.isin(runs.anchor, wanted[crowded])
                owner, count = runs.owner[chosen], (runs.last - runs.first)[chosen] + 1
                inside = runs.first[chosen] - runs.offsets[owner]
                heavy.append((np.repeat(place[owner], count), _ranges(inside, count), _ranges(base + runs.first[chosen], count)))
                chosen = fresh[runs.owner] & np.isin(runs.anchor, wanted[~crowded])
                owner = runs.owner[chosen]
                inside = runs.first[chosen] - runs.offsets[owner]
                parts.append((runs.anchor[chosen], place[owner], inside, runs.last[chosen] - runs.first[chosen] + length, base + runs.first[chosen]))
                buffers.append(runs.data)
                base += len(runs.data)
            anchor, owner, inside, size, at = (np.concatenate(x) for x in zip(*parts))
            data = np.concatenate(buffers)
            sums = running_hash(data)
            rows = told_apart(number, digests, double, sums, *(np.concatenate(x) for x in zip(*heavy)))
            if not len(anchor):
                yield pa.RecordBatch.from_pylist(rows, schema)
                continue
            # Equal stretches of this batch travel once, with all their owners; a text that stands in it twice owns its
            # stretches twice. All that a shard learns of a stretch is in one row, so a task that is repeated with its
            # rows in another order tells each shard the same.
            twice = np.flatnonzero(np.isin(owner, np.fromiter(double, np.int64, len(double))))
            anchor, owner, inside, size, at = (np.concatenate([x, x[twice]]) for x in (anchor, owner, inside, size, at))
            prints = span_hash(sums, at, at + size)
            shard = _shards(anchor, shards)
            order = np.lexsort((owner, prints, size, anchor, shard))
            anchor, owner, inside, size, at, prints, shard = (x[order] for x in (anchor, owner, inside, size, at, prints, shard))
            new = np.ones(len(order), bool)
            new[1:] = (prints[1:] != prints[:-1]) | (size[1:] != size[:-1]) | (anchor[1:] != anchor[:-1])
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[k], cuts[k + 1])
                first = new[part]
                who, place = np.unique(owner[part], return_inverse=True)
                rows.append(
                    {
                        "shard": int(k), "batch": number, "kind": STRETCHES, "digests": [digests[w] for w in who],
                        "owners": pack(np.concatenate([place, inside[part], np.cumsum(first) - 1]).astype(np.int64)),
                        "sizes": pack(size[part][first].astype(np.int64)),
                        "bytes": pack(data[_ranges(at[part][first], size[part][first])]),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.mapInArrow(send, cells)


def repeated_ranges(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """(digest, ranges): byte ranges of a text that repeat, packed starts and stops; a text can have several rows.

    ``docs`` as in ``sent_stretches``.
    """

    def scan(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        rows = table.filter(pa.array(kinds == STRETCHES)).sort_by("batch")
        index = LogIndex(length)
        digests: list[bytes] = []
        none = np.zeros(0, np.int64)
        owners, insides, hits = [none], [none], [none]
        known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # owner, start and stop of stretches that repeat as a whole
        total = 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size_waiting = 0

        def flush() -> None:
            nonlocal total, size_waiting
            starts, base = [], 0
            for data, sizes in waiting:
                begins = np.cumsum(sizes) - sizes
                starts.append(base + _ranges(begins, sizes - length + 1))
                base += len(data)
            starts = np.concatenate(starts)
            found = index.add(np.concatenate([data for data, _ in waiting]), starts, total + np.arange(len(starts)))
            hits.append(np.unique(found))
            total += len(starts)
            waiting.clear()
            size_waiting = 0

        for names, cell, sizes, body in zip(*(rows[c].to_pylist() for c in ("digests", "owners", "sizes", "bytes"))):
            place, inside, which = unpack(cell, np.int64).reshape(3, -1)
            sizes, data = unpack(sizes, np.int64), unpack(body, np.uint8)
            owner = place + len(digests)
            digests += names
            several = (np.bincount(which, minlength=len(sizes)) > 1)[which]
            known.append((owner[several], inside[several], (inside + sizes[which])[several]))
            # Only a stretch with a single owner has anything left to find out.
            single = np.full((2, len(sizes)), -1, np.int64)
            single[:, which[~several]] = owner[~several], inside[~several]
            count = sizes - length + 1
            owners.append(np.repeat(single[0], count).astype(np.int32))
            insides.append(_ranges(single[1], count))
            waiting.append((data, sizes))
            size_waiting += int(count.sum())
            if size_waiting >= BATCH_SUFFIXES:
                flush()
        if waiting:
            flush()
        found = np.unique(np.concatenate(hits))
        owner, inside = np.concatenate(owners)[found], np.concatenate(insides)[found]
        owner, inside = owner[owner >= 0].astype(np.int64), inside[owner >= 0]
        known.append((owner, inside, inside + length))

        settled = table.filter(pa.array(kinds == SETTLED))
        for names, cell in zip(*(settled[c].to_pylist() for c in ("digests", "owners"))):
            place, start, stop = unpack(cell, np.int64).reshape(3, -1)
            known.append((place + len(digests), start, stop))
            digests += names
        prints, owners, insides = [np.zeros(0, np.uint64)], [none], [none]
        told = table.filter(pa.array(kinds == PRINTS))
        for names, cell, body in zip(*(told[c].to_pylist() for c in ("digests", "owners", "bytes"))):
            place, inside = unpack(cell, np.int64).reshape(2, -1)
            prints.append(unpack_sorted(body, np.uint64))
            owners.append(np.where(place < 0, -1, place + len(digests)))
            insides.append(inside)
            digests += names
        # A batch tells a string once, so what is told twice repeats.
        place, times = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)[1:]
        owner, inside = np.concatenate(owners), np.concatenate(insides)
        met = (times[place] > 1) & (owner >= 0)
        known.append((owner[met], inside[met], inside[met] + length))
        owner, start, stop = (np.concatenate(x) for x in zip(*known))
        return _range_rows(digests, owner, start, stop)

    sent = sent_stretches(docs, shards, length)
    return materialize(sent.groupBy("shard").applyInArrow(lambda t: scan(t), "digest binary, ranges binary"), "repeated-ranges")


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: the maximal removed byte ranges and the bytes that stay."""
    if length < GRAM:
        raise ValueError(f"matches must have at least {GRAM} bytes")
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = docs.select("doc_id", F.col(text).alias("text"), digest.alias("digest"))
    size = text_bytes(rows)
    shards = shard_count(size, SHARD_BYTES)
    anchors = repeated_anchors(rows.select("text", "digest"), shard_count(size, ANCHOR_BYTES), length)
    found = repeated_ranges(rows.select("text", "digest").join(anchors.hint("shuffle_hash"), "digest"), shards, length)
    ranges = found.groupBy("digest").agg(F.collect_set("ranges").alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, "text"):
            data, offsets = text_buffer(step.column("text"))
            spans, kept = [], []
            for low, high, cells in zip(offsets, offsets[1:], step.column("ranges").to_pylist()):
                whole = data[low:high]
                if not cells:
                    spans.append([])
                    kept.append(whole.tobytes())
                    continue
                parts = [unpack(c, np.int64).reshape(2, -1) for c in cells]
                starts, stops = _joined(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
                stays = np.ones(len(whole), bool)
                stays[_ranges(starts, stops - starts)] = False
                spans.append([{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist())])
                kept.append(whole[stays].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [step.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(ranges.hint("shuffle_hash"), "digest", "left").select("doc_id", "text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
