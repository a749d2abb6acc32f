"""N-gram Jaccard join: which documents share enough of their word n-grams, by rare-first prefix filtering.

A document's set holds the 64-bit hashes of its distinct n-grams; equal sets are one class.

1. Document frequencies. Batches of texts send their n-grams, packed, to shards by hash; a shard counts and sends back
   those in two documents or more. An n-gram that is frequent within a batch goes as a count, and its documents stay.
2. Prefixes. Ordered by frequency, a class needs only its first n - ceil(t n) + 1 n-grams: two classes that are similar
   enough share one of these. N-grams of one document come first and have no partner, so most classes end here.
3. Candidates meet on prefix n-grams. Length, positional and suffix filters bound the overlap of a pair from its sizes,
   the places of the shared prefix n-grams and counts by hash range; what is left is verified once, exactly.
4. Only components are asked for, so first the classes of an n-gram are compared with one of them, a hub; pairs that a
   component joins by then need no check. The last round checks all remaining pairs of different components, each in
   the first n-gram that both prefixes hold, so no link between components is missed and a large group of near copies
   does not give all its pairs.

Defined results: a null text, or one without words, has an empty set and is its own component; a text with fewer words
than n has its whole sequence as one n-gram; equal rows are linked; rows without id get the smallest id that they reach,
or null; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import Groups, Words, dealt, mix, shard_count, text_buffer, text_bytes, text_steps
from cohortflow.llm.components import components
from cohortflow.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from cohortflow.session import materialize

BATCH_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Documents of a batch from which on an n-gram is sent as a count.
LOCALLY_HOT = 64
_HOT = np.uint32(1 << 31)
#: Rounds that compare with a hub before the round that compares all.
HUB_ROUNDS = 1
#: Ranges of the hash space that the suffix filter counts in.
RANGES = 16
_FACTORS = mix(np.arange(101, 165, dtype=np.uint64))
MEMBER, ENTRIES, LOCAL, RETURNED = 0, 1, 2, 3
CELLS = "shard int, batch long, kind int, doc_id long, mark long, place int, n long, digest binary, names binary, hashes binary, counts binary"


def shingles(column: pa.Array, n: int) -> Groups:
    """Distinct n-gram hashes per text, sorted."""
    words = Words(column)
    hashes = words.hashes()
    total = len(hashes)
    summed = np.zeros(total, np.uint64)
    ends = words.first[1:][words.owner]  # of the text that a word belongs to
    here = np.arange(total)
    for k in range(n):
        inside = here + k < ends
        summed[inside] += hashes[(here + k)[inside]] * (_FACTORS[k] | np.uint64(1))
    # The windows that fit, or the first one of a text with fewer words; its length tells it from longer ones.
    short = (words.counts < n)[words.owner]
    starts = (here + n <= ends) | (short & (here == words.first[:-1][words.owner]))
    summed[short] += mix(words.counts[words.owner][short].astype(np.uint64))
    return Groups(words.owner[starts], mix(summed[starts]))


def _cells(rows: list[dict]) -> pa.RecordBatch:
    fields = [
        ("shard", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("place", pa.int32()),
        ("n", pa.int64()), ("digest", pa.binary()), ("names", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()),
    ]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def _send(batch: int, shards: int, members: list[dict], owner: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """A batch's rows: one per document, one per shard with its n-grams, one with what is frequent in the batch."""
    rows = members
    names, values = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((owner, np.uint32), (hashes, np.uint64)))
    order = np.argsort(values, kind="stable")
    names, values = names[order], values[order]
    first = np.flatnonzero(np.diff(values, prepend=~values[:1]) != 0) if len(values) else np.zeros(0, int)
    times = np.diff(np.append(first, len(values)))
    hot = np.repeat(times >= LOCALLY_HOT, times)
    if hot.any():
        rows.append({"shard": dealt(batch, shards), "batch": batch, "kind": LOCAL, "names": pack(names[hot]), "hashes": pack_sorted(values[hot])})
        kept = ~hot
        kept[first[times >= LOCALLY_HOT]] = True
        names = names.copy()
        names[first[times >= LOCALLY_HOT]] = _HOT | times[times >= LOCALLY_HOT].astype(np.uint32)
        names, values = names[kept], values[kept]
    # Sorted values fall into shards in order.
    shard = ((values >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cuts)):
        low, high = cuts[k], cuts[k + 1]
        rows.append({"shard": int(k), "batch": batch, "kind": ENTRIES, "names": pack(names[low:high]), "hashes": pack_sorted(values[low:high])})
    return _cells(rows)


def _documents(docs: DataFrame, n: int, shards: int, text: str) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that is repeated reads the same rows, so its batches get the same numbers.
        number = TaskContext.get().partitionId() << 24
        members, owner, hashes, known, size = [], [], [], {}, 0
        for step in text_steps(batches, text):
            sets = shingles(step.column(text), n)
            cuts = np.searchsorted(sets.owner, np.arange(step.num_rows + 1))
            ids, marks = step.column("doc_id").to_pylist(), step.column("mark").to_pylist()
            for row, (low, high) in enumerate(zip(cuts, cuts[1:])):
                member = {"shard": dealt(number, shards), "batch": number, "kind": MEMBER, "doc_id": ids[row], "mark": marks[row]}
                member["n"] = int(high - low)
                if high > low:
                    values = sets.values[low:high]
                    member["digest"] = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                    if member["digest"] not in known:
                        known[member["digest"]] = len(known)
                        owner.append(np.full(high - low, known[member["digest"]], np.uint32))
                        hashes.append(values)
                    member["place"] = known[member["digest"]]
                members.append(member)
            size += len(text_buffer(step.column(text))[0])
            if size >= BATCH_BYTES:
                yield _send(number, shards, members, owner, hashes)
                members, owner, hashes, known, size, number = [], [], [], {}, 0, number + 1
        if members:
            yield _send(number, shards, members, owner, hashes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text))
    return rows.mapInArrow(send, CELLS)


def _count(table: pa.Table) -> pa.Table:
    """A shard: members pass; n-grams of two documents or more go back to their batches with their frequency."""
    kinds = table["kind"].to_numpy()
    rows = [table.filter(pa.array(kinds != ENTRIES))]
    entries = table.filter(pa.array(kinds == ENTRIES))
    batches = entries["batch"].to_numpy()
    names = [unpack(x.as_py(), np.uint32) for x in entries["names"]]
    hashes = [unpack_sorted(x.as_py(), np.uint64) for x in entries["hashes"]]
    if names:
        source = np.repeat(np.arange(len(names), dtype=np.uint32), [len(x) for x in names])
        name, value = np.concatenate(names), np.concatenate(hashes)
        del names, hashes
        order = np.argsort(value, kind="stable")
        name, value, source = name[order], value[order], source[order]
        weight = np.where(name >= _HOT, name & ~_HOT, 1).astype(np.int64)
        first = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0)
        frequency = np.repeat(np.add.reduceat(weight, first), np.diff(np.append(first, len(value))))
        again = frequency > 1
        name, value, source, frequency = name[again], value[again], source[again], frequency[again].astype(np.uint64)
        order = np.argsort(source, kind="stable")
        name, value, source, frequency = name[order], value[order], source[order], frequency[order]
        cuts = np.searchsorted(source, np.arange(len(batches) + 1))
        back = [
            {"batch": int(b), "kind": RETURNED, "names": pack(name[low:high]), "hashes": pack_sorted(value[low:high]), "counts": pack(frequency[low:high])}
            for b, low, high in zip(batches, cuts, cuts[1:])
            if high > low
        ]
        rows.append(pa.Table.from_batches([_cells(back)]))
    return pa.concat_tables([r.select(rows[0].column_names) for r in rows])


def _prefixes(table: pa.Table, percent: int) -> list[dict]:
    """A batch: its classes that have a prefix n-gram in common with any other class."""
    kinds = table["kind"].to_numpy()

    def cells(kind: int, column: str, read, dtype) -> list[np.ndarray]:
        return [read(x.as_py(), dtype) for x in table.filter(pa.array(kinds == kind))[column]]

    join = lambda parts, dtype: np.concatenate(parts) if parts else np.zeros(0, dtype)
    name = join(cells(RETURNED, "names", unpack, np.uint32), np.uint32)
    value = join(cells(RETURNED, "hashes", unpack_sorted, np.uint64), np.uint64)
    count = join(cells(RETURNED, "counts", unpack, np.uint64), np.uint64)
    hot = name >= _HOT
    order = np.argsort(value[hot])
    hot_values, hot_counts = value[hot][order], count[hot][order]
    local_name = join(cells(LOCAL, "names", unpack, np.uint32), np.uint32)
    local_value = join(cells(LOCAL, "hashes", unpack_sorted, np.uint64), np.uint64)
    local_count = hot_counts[np.searchsorted(hot_values, local_value)] if len(local_value) else np.zeros(0, np.uint64)
    name = np.concatenate([name[~hot], local_name])
    value, count = np.concatenate([value[~hot], local_value]), np.concatenate([count[~hot], local_count])
    order = np.lexsort((value, count, name))
    name, value, count = name[order], value[order], count[order]
    members = table.filter(pa.array((kinds == MEMBER) & table["place"].is_valid().to_numpy()))
    result, seen = [], set()
    for place, n, digest in zip(members["place"].to_pylist(), members["n"].to_pylist(), members["digest"].to_pylist()):
        if place in seen:
            continue
        seen.add(place)
        low, high = np.searchsorted(name, [place, place + 1])
        alone = n - (high - low)
        used = n + (-percent * n // 100) + 1 - alone  # n - ceil(t n) + 1 less those that no other class has
        if used > 0:
            result.append({"digest": digest, "n": n, "used": int(used), "hashes": value[low:high].tobytes()})
    return result


def classes_and_members(docs: DataFrame, n: int, percent: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes that may have a partner (digest, n, used, hashes from rare to frequent), and all members (doc_id, mark, n, digest),
    where mark is a hash of the text."""
    shards = shard_count(text_bytes(docs, text), SHARD_BYTES)
    cells = _documents(docs, n, shards, text).groupBy("shard").applyInArrow(lambda t: _count(t), CELLS)
    cells = materialize(cells, "shingle-cells")

    def prefixes(table: pa.Table) -> pa.Table:
        schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("used", pa.int32()), ("hashes", pa.binary())])
        return pa.Table.from_pylist(_prefixes(table, percent), schema)

    found = cells.groupBy("batch").applyInArrow(lambda t: prefixes(t), "digest binary, n long, used int, hashes binary")
    classes = materialize(found.dropDuplicates(["digest"]), "shingle-classes")
    return classes, cells.where(F.col("kind") == MEMBER).select("doc_id", "mark", "n", "digest")


def _postings(classes: DataFrame) -> DataFrame:
    """(hash, digest, n, place, ranges): the prefix n-grams of all classes; ranges are the counts of the suffix filter."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows: dict[str, list] = {k: [] for k in ("hash", "digest", "n", "place", "ranges")}
                for digest, n, used, cell in zip(*(part.column(c).to_pylist() for c in ("digest", "n", "used", "hashes"))):
                    values = np.frombuffer(cell, np.uint64)
                    ranges = np.bincount((values >> np.uint64(60)).astype(np.int64), minlength=RANGES).tolist()
                    used = min(used, len(values))
                    rows["hash"] += values[:used].view(np.int64).tolist()
                    rows["digest"] += [digest] * used
                    rows["n"] += [n] * used
                    rows["place"] += range(n - len(values), n - len(values) + used)
                    rows["ranges"] += [ranges] * used
                schema = pa.schema([("hash", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("place", pa.int64()), ("ranges", pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_pydict(rows, schema)

    return classes.mapInArrow(spread, "hash long, digest binary, n long, place long, ranges array<int>")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs whose sets are similar enough. ``pairs`` has a, b, each pair once."""
    lists = classes.select("digest", "n", "hashes")
    joined = pairs.join(lists.toDF("a", "n_a", "hashes_a"), "a").join(lists.toDF("b", "n_b", "hashes_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "hashes_a", "hashes_b"))
            kept = []
            for n_a, n_b, x, y in zip(*columns):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                kept.append(100 * common >= percent * (n_a + n_b - common))
            links = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([links.column("a"), links.column("b")], ["u", "v"])

    return joined.mapInArrow(verify, "u binary, v binary")


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that the length, positional and suffix filters leave, each once.

    ``pairs`` has a row for each shared prefix n-gram. All that a pair can have in common is its shared prefix n-grams
    and what follows the last of them on the shorter side; and in each range of the hash space no more than the
    smaller count, next to n-grams that only one class has.
    """
    needed = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    length = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    in_ranges = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    bounded = pairs.where(length).where(in_ranges >= needed)
    after = F.least(F.col("n_a") - F.max("place_a") - 1, F.col("n_b") - F.max("place_b") - 1)
    grouped = bounded.groupBy("a", "b", "n_a", "n_b").agg((F.count("*") + after).alias("most"))
    return grouped.where(F.col("most") >= needed).select("a", "b")


def link_components(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component): the classes that are linked with others; all other classes are their own component."""
    postings = materialize(_postings(classes), "postings")
    labels = postings.sparkSession.createDataFrame([], "digest binary, component binary")
    links = tried = None
    for turn in range(HUB_ROUNDS + 1):
        label = F.coalesce("component", "digest")
        open_ = postings.join(labels, "digest", "left").withColumn("label", label).drop("component") if links is not None else postings.withColumn("label", F.col("digest"))
        mixed = open_.groupBy("hash").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        open_ = materialize(open_.join(mixed.select("hash"), "hash"), "open-postings")
        if open_.isEmpty():
            break
        if turn < HUB_ROUNDS:
            # The hub of an n-gram has the fewest n-grams of its own, as the middle of a group of near copies has; ties
            # are drawn by hash, otherwise in each round.
            alone = F.col("n") - F.aggregate("ranges", F.lit(0), lambda s, x: s + x)
            by = F.struct(alone.alias("alone"), F.xxhash64("digest", F.lit(turn)).alias("h"), "digest", "n", "place", "ranges", "label")
            hubs = open_.groupBy("hash").agg(F.min(by).alias("hub")).select("hash", "hub.digest", "hub.n", "hub.place", "hub.ranges", "hub.label")
            pairs = _meet(open_, hubs, F.lit(True))
        else:
            open_ = open_.join(_prefix_arrays(classes), "digest")
            pairs = _first_meetings(open_, percent)
        pairs = _candidates(pairs, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = materialize(_verified(pairs, classes, percent), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        labels = materialize(components(links), "labels").toDF("digest", "component")
    return labels.toDF("node", "component")


def _prefix_arrays(classes: DataFrame) -> DataFrame:
    """(digest, prefix): the prefix n-grams of each class in order, from rare to frequent."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(batch.column("hashes").to_pylist(), batch.column("used").to_pylist())
            prefixes = pa.array([np.frombuffer(cell, np.int64)[:used] for cell, used in cells], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), prefixes], ["digest", "prefix"])

    return classes.select("digest", "used", "hashes").mapInArrow(spread, "digest binary, prefix array<long>")


def _meet(left: DataFrame, right: DataFrame, condition) -> DataFrame:
    """Rows (a, b, ...) where a class of ``left`` and one of ``right`` share an n-gram and have different components."""
    left, right = left.alias("l"), right.alias("r")
    joined = left.join(right, (F.col("l.hash") == F.col("r.hash")) & (F.col("l.label") != F.col("r.label")) & condition)
    swap = F.col("l.digest") > F.col("r.digest")
    pick = lambda c, first, second: F.when(swap, F.col(f"{second}.{c}")).otherwise(F.col(f"{first}.{c}"))
    names = {"digest": "", "n": "n_", "place": "place_", "ranges": "ranges_"}
    return joined.select(
        *[pick(c, "l", "r").alias(f"{p}a") for c, p in names.items()], *[pick(c, "r", "l").alias(f"{p}b") for c, p in names.items()]
    )


def _first_meetings(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different components, each at the first n-gram that both prefixes hold.

    Up to there a pair has nothing in common, so its places bound the overlap; sizes and ranges bound it as well.
    """
    n_l, n_r = F.col("l.n"), F.col("r.n")
    needed = F.ceil(F.lit(percent) * (n_l + n_r) / F.lit(100 + percent))
    after = F.least(n_l - F.col("l.place"), n_r - F.col("r.place"))
    in_ranges = F.aggregate(F.zip_with("l.ranges", "r.ranges", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    before = lambda side: F.slice(f"{side}.prefix", 1, F.array_position(f"{side}.prefix", F.col(f"{side}.hash")).cast("int") - 1)
    first = ~F.arrays_overlap(before("l"), before("r"))
    once = F.col("l.digest") < F.col("r.digest")
    return _meet(open_, open_, once & (after >= needed) & (in_ranges >= needed) & first)


def _labelled(docs: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """All members with ``label``, a name of their component; null for an empty set."""
    classes, members = classes_and_members(docs, n, percent, text)
    labels = link_components(classes, percent).toDF("digest", "component")
    named = members.join(labels, "digest", "left")
    return named.select("doc_id", "mark", "n", F.coalesce("component", "digest").alias("label"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: documents whose n-gram sets have a Jaccard similarity of
    ``percent`` / 100 or more are linked; the component is named by its smallest doc_id."""
    named = _labelled(docs, n, percent, text)
    smallest = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.join(smallest, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the smallest doc_id (and, among
    equal ids, the smallest text hash) stays, once. Rows with an empty set all stay."""
    named = _labelled(docs, n, percent, text)
    first = named.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("id"), F.col("first.mark").alias("mark"), F.lit(1).alias("copies"))
    empty = named.where("label is null").groupBy(F.col("doc_id").alias("id"), "mark").agg(F.count("*").cast("int").alias("copies"))
    kept = kept.union(empty)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("mark"))
    same = F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.mark") == F.col("k.mark"))
    chosen = rows.alias("r").join(kept.alias("k"), same).select("row", "r.id", "r.mark", "copies")
    again = F.row_number().over(Window.partitionBy("id", "mark").orderBy("id"))
    return chosen.withColumn("again", again).where("again <= copies").select("row.*")
