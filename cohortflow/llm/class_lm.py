"""LM scoring with a Brown class-based bigram model.

P(word | previous) = P(class of word | history class of previous) * P(word | class). All steps are over the whole training
text:

1. Word counts, packed by batch and summed in shards of the hash space. The most frequent words (a fixed number) are
   known to all tasks; any other word is looked up in its shard.
2. History classes. What a task has to know of a previous word must be of fixed size: a frequent word is a type of its
   own, other words share the type of their ending, and exchange clustering of the types' neighbour counts moves types
   between classes as long as the likelihood grows.
3. Classes of all words of the vocabulary. The shards hold how often each word follows each history class. Every word
   moves to the class under which these counts are likeliest, given a table of classes by history classes that travels
   to all shards; the tables of the shards are summed, and so on until the likelihood no longer grows. Neither step can
   lower it. The classes begin as those of the words' types, which have odds of their own, as few contexts say little.
4. Scoring: frequent words are priced where the text is, other words in their shards, and the parts of a document come
   back together by batch.

A word's key holds 48 bits of its hash and 16 of its ending. Counts and classes of words grow with the corpus and are never
on the driver; only the fixed tables are.

Defined results: a null or empty text has one token, the end; without training text all counts are 0 and every token has
probability 1 in the base, and the model falls back to equal classes; a word that was not seen has the class of its
ending; equal texts get equal scores up to rounding; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import Groups, Words, dealt, mix, shard_count, text_buffer, text_bytes, text_steps
from cohortflow.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from cohortflow.session import materialize

BATCH_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
#: Words that all tasks know; of them, and of the endings, so many are types of histories; classes.
FREQUENT, WORD_TYPES, ENDING_TYPES, CLASSES = 8192, 1024, 510, 64
#: The likelihood no longer grows when a round adds less than this share of it; for the sweeps over the types, a share of
#: what all sweeps have added.
GROWTH, LAST_SWEEP = 1e-5, 0.01
#: What the contexts of a word have to speak for another class than that of its type, as a log of odds.
STAY = 6.0
END, OTHER = 0, 1
TYPES = 2 + WORD_TYPES + ENDING_TYPES
ADDED = 0.5
PRIOR = 2.0
DOCUMENT, ENTRIES, PRICED = 0, 1, 2
_LOW = np.uint64(0xFFFF)


def word_keys(words: Words) -> np.ndarray:
    last = [words.data[np.maximum(words.stops - k, words.starts)].astype(np.uint64) << np.uint64(8 * (k - 1)) for k in (1, 2, 3)]
    return (words.hashes() & ~_LOW) | (mix(last[0] | last[1] | last[2]) & _LOW)


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


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted ``keys`` have to be cut, by shard."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def count_words(docs: DataFrame, shards: int, text: str) -> DataFrame:
    """(shard, keys, counts, words, tokens): the sorted keys of all words of ``docs`` with their counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, steps in _numbered(batches, text):
            keys, counts = np.unique(np.concatenate([word_keys(Words(s.column(text))) for s in steps]), return_counts=True)
            cuts = _shards(keys, shards)
            rows = [
                {"shard": int(k), "keys": pack_sorted(keys[cuts[k] : cuts[k + 1]]), "counts": pack(counts[cuts[k] : cuts[k + 1]])}
                for k in np.flatnonzero(np.diff(cuts))
            ]
            schema = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_sorted(x.as_py(), np.uint64) for x in table["keys"]])
        counts = np.concatenate([unpack(x.as_py(), np.int64) for x in table["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        keys, counts = keys[first], np.add.reduceat(counts, first)
        row = {"shard": key[0], "keys": pa.array([pack_sorted(keys)]), "counts": pa.array([pack(counts)]), "words": [len(keys)], "tokens": [int(counts.sum())]}
        return pa.table(row | {"shard": pa.array([key[0].as_py()], pa.int32())})

    sent = docs.select(F.col(text)).mapInArrow(send, "shard int, keys binary, counts binary")
    summed = sent.groupBy("shard").applyInArrow(add, "shard int, keys binary, counts binary, words long, tokens long")
    return materialize(summed, "word-counts")


def _frequent(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the ``FREQUENT`` most frequent words, sorted by key; a shard proposes as many at most."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys, counts = unpack_sorted(keys, np.uint64), unpack(counts, np.int64)
                top = np.lexsort((keys, -counts))[:FREQUENT]
                yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(counts[top])], ["key", "count"])

    proposed = vocabulary.select("keys", "counts").mapInArrow(propose, "key long, count long")
    top = proposed.orderBy(F.desc("count"), "key").limit(FREQUENT).toArrow()
    keys, counts = top["key"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


class Types:
    """Types of word keys: frequent words by look-up, other words by ending."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, endings: np.ndarray):
        self.keys, self.counts = keys, counts
        self.own = np.zeros(len(keys), np.int64)
        top = np.lexsort((keys, -counts))[:WORD_TYPES]
        self.own[top] = 2 + np.arange(len(top))
        self.by_ending = np.full(1 << 16, OTHER, np.int64)
        # Endings by the tokens that no own type takes.
        top = np.argsort(-endings, kind="stable")[:ENDING_TYPES]
        top = top[endings[top] > 0]
        self.by_ending[top] = 2 + WORD_TYPES + np.arange(len(top))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words (or -1) and type of each key."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        own = self.own[place] if len(self.keys) else np.zeros(len(keys), np.int64)
        kinds = np.where(known & (own > 0), own, self.by_ending[(keys & _LOW).astype(np.int64)])
        return np.where(known, place, -1), kinds


def _by_type(vocabulary: DataFrame, find, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words per group; ``find`` gives the groups of keys. Two fixed arrays, summed over shards."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                counts = unpack(counts, np.int64)
                group = find(unpack_sorted(keys, np.uint64))
                here, place = np.unique(group, return_inverse=True)
                tokens = np.bincount(place, weights=counts, minlength=len(here)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(tokens), pa.array(np.bincount(place, minlength=len(here)))], ["g", "tokens", "words"])

    found = vocabulary.select("keys", "counts").mapInArrow(measure, "g long, tokens long, words long")
    found = found.groupBy("g").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    tokens, words = np.zeros(width, np.int64), np.zeros(width, np.int64)
    tokens[found["g"].to_numpy()], words[found["g"].to_numpy()] = found["tokens"].to_numpy(), found["words"].to_numpy()
    return tokens, words


def _sequences(kinds: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous type, type and text of all tokens, the end of each text included; a text follows an end."""
    counts = words.counts + 1
    last = np.cumsum(counts) - 1
    token = np.full(int(counts.sum()), END, np.int64)
    is_word = np.ones(len(token), bool)
    is_word[last] = False
    token[is_word] = kinds
    before = np.full(len(token), END, np.int64)
    before[1:] = token[:-1]
    before[last - words.counts] = END
    return before, token, np.repeat(np.arange(words.texts), counts)


def _neighbours(docs: DataFrame, types, text: str) -> np.ndarray:
    """Counts of neighbouring types, a table of ``TYPES`` by ``TYPES``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TYPES * TYPES, np.int64)
        for step in text_steps(batches, text):
            words = Words(step.column(text))
            before, token, _ = _sequences(types.value.find(word_keys(words))[1], words)
            codes, times = np.unique(before * TYPES + token, return_counts=True)
            table[codes] += times
        cuts = np.arange(0, TYPES * TYPES + 1, TYPES * 64)
        for low, high in zip(cuts, np.append(cuts[1:], TYPES * TYPES)):
            here = low + np.flatnonzero(table[low:high])
            if len(here):
                row = {"slot": int(low), "codes": pack_sorted(here), "times": pack(table[here])}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("slot", pa.int64()), ("codes", pa.binary()), ("times", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        slot = table["slot"][0].as_py()
        total = np.zeros(TYPES * 64, np.int64)
        for codes, times in zip(table["codes"].to_pylist(), table["times"].to_pylist()):
            total[unpack_sorted(codes, np.int64) - slot] += unpack(times, np.int64)
        here = np.flatnonzero(total)
        return pa.table({"codes": pa.array([pack_sorted(slot + here)]), "times": pa.array([pack(total[here])])})

    parts = docs.select(F.col(text)).mapInArrow(count, "slot long, codes binary, times binary")
    result = np.zeros(TYPES * TYPES)
    for row in parts.groupBy("slot").applyInArrow(lambda t: add(t), "codes binary, times binary").collect():
        result[unpack_sorted(bytes(row["codes"]), np.int64)] = unpack(bytes(row["times"]), np.int64)
    return result.reshape(TYPES, TYPES)


def exchange_classes(pairs: np.ndarray, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """The class of each type: types move, one by one, to the class that raises the likelihood of class bigrams most.

    The likelihood is the sum of n log n over class pairs, less that over classes as first and as second part. Class 0
    holds the end alone. Frequent types are dealt out first, in turn. A sweep that moves no type, or adds less than
    ``LAST_SWEEP`` of what all have added, is the last, unless fewer ``sweeps`` are asked for.
    """
    total = pairs.sum(axis=0)
    order = np.argsort(-total, kind="stable")
    order = order[order != END]
    assigned = np.zeros(len(pairs), np.int64)
    assigned[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.zeros((len(pairs), classes))
    member[np.arange(len(pairs)), assigned] = 1
    table = member.T @ pairs @ member
    entropy = lambda n: n * np.log(np.maximum(n, 1))
    turn, added = 0, 0.0
    while sweeps is None or turn < sweeps:
        turn += 1
        moved, gained = 0, 0.0
        for kind in order:
            out, into = pairs[kind] @ member, pairs[:, kind] @ member
            own = pairs[kind, kind]
            at = assigned[kind]
            if not out.any() and not into.any():
                continue
            # Without this type; its step to itself leaves both its row and its column.
            out_rest, into_rest = out.copy(), into.copy()
            out_rest[at] -= own
            into_rest[at] -= own
            table[at] -= out_rest
            table[:, at] -= into_rest
            table[at, at] -= own
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            cells = entropy(table)
            gain = (entropy(table + out_rest) - cells).sum(axis=1) + (entropy(table + into_rest[:, None]) - cells).sum(axis=0)
            both = np.diag(table)
            new = out_rest + into_rest + own
            gain += entropy(both + new) - entropy(both + out_rest) - entropy(both + into_rest) + entropy(both)
            sent, got = out_rest.sum() + own, into_rest.sum() + own
            gain -= entropy(rows + sent) - entropy(rows) + entropy(columns + got) - entropy(columns)
            gain[0] = -np.inf
            best = int(gain.argmax()) if gain.max() > gain[at] + 1e-9 else at
            table[best] += out_rest
            table[:, best] += into_rest
            table[best, best] += own
            if best != at:
                member[kind, at], member[kind, best], assigned[kind] = 0, 1, best
                moved += 1
                gained += gain[best] - gain[at]
        added += gained
        if not moved or gained <= LAST_SWEEP * added:
            break
    return assigned


def _log_shares(table: np.ndarray) -> np.ndarray:
    """Per class (column of ``table``, histories by classes), log share of each history among what precedes the class."""
    table = table + PRIOR * (table.sum(axis=1, keepdims=True) + 1) / (table.sum() + len(table))
    return np.log(table / table.sum(axis=0, keepdims=True))


def contexts(train: DataFrame, vocabulary: DataFrame, histories, shards: int, text: str) -> DataFrame:
    """(shard, words, before, times, kinds): per shard, the places of its words in ``vocabulary`` with the history classes
    that precede them and how often, and the class of each word's type; a row with shard -1 is about the end.

    ``histories`` is a broadcast of the types and the history class of each.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, classes = histories.value
        schema = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("before", pa.binary()), ("times", pa.binary())])
        for _, steps in _numbered(batches, text):
            keys, before, ends = [], [], np.zeros(CLASSES, np.int64)
            for step in steps:
                words = Words(step.column(text))
                found = word_keys(words)
                previous, token, _ = _sequences(types.find(found)[1], words)
                is_word = token != END
                keys.append(found)
                before.append(classes[previous[is_word]].astype(np.uint64))
                ends += np.bincount(classes[previous[~is_word]], minlength=CLASSES)
            groups = Groups(np.concatenate(keys), np.concatenate(before))
            cuts = _shards(groups.owner, shards)
            rows = [{"shard": -1, "keys": pack_sorted(np.zeros(0, np.uint64)), "before": b"", "times": pack(ends)}]
            for k in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[k], cuts[k + 1])
                rows.append(
                    {"shard": int(k), "keys": pack_sorted(groups.owner[part]), "before": pack(groups.values[part].astype(np.uint8)), "times": pack(groups.sizes[part].astype(np.uint32))}
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    def add(cells: pa.Table, vocabulary_: pa.Table) -> pa.Table:
        shard = cells["shard"][0].as_py() if cells.num_rows else -2
        if shard < 0 or not vocabulary_.num_rows:
            times = sum((unpack(x.as_py(), np.int64) for x in cells["times"]), np.zeros(CLASSES, np.int64)) if shard == -1 else np.zeros(CLASSES, np.int64)
            rows = [{"shard": -1, "words": b"", "before": b"", "times": pack(times), "kinds": b""}] if shard == -1 else []
            return pa.Table.from_pylist(rows, out)
        types, classes = histories.value
        keys = unpack_sorted(vocabulary_["keys"][0].as_py(), np.uint64)
        place = np.searchsorted(keys, np.concatenate([unpack_sorted(x.as_py(), np.uint64) for x in cells["keys"]])).astype(np.int64)
        code = place * CLASSES + np.concatenate([unpack(x.as_py(), np.uint8) for x in cells["before"]])
        times = np.concatenate([unpack(x.as_py(), np.uint32) for x in cells["times"]]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        code, times = code[order], times[order]
        first = np.flatnonzero(np.diff(code, prepend=-1) != 0)
        code, times = code[first], np.add.reduceat(times, first)
        kinds = classes[types.find(keys)[1]].astype(np.uint8)
        row = {"shard": shard, "words": pack_sorted(code // CLASSES), "before": pack((code % CLASSES).astype(np.uint8)), "times": pack(times), "kinds": pack(kinds)}
        return pa.Table.from_pylist([row], out)

    out = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("before", pa.binary()), ("times", pa.binary()), ("kinds", pa.binary())])
    sent = train.select(F.col(text)).mapInArrow(send, "shard int, keys binary, before binary, times binary")
    both = sent.groupBy("shard").cogroup(vocabulary.select("shard", "keys").groupBy("shard"))
    return materialize(both.applyInArrow(lambda a, b: add(a, b), "shard int, words binary, before binary, times binary, kinds binary"), "word-contexts")


def _best_classes(words: np.ndarray, before: np.ndarray, times: np.ndarray, kinds: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
    """The class of each word under which its contexts are likeliest, never the end's; and the sum of logs.

    The class of a word's type, ``kinds``, is likelier beforehand, so a word of few tokens keeps it as a rule.
    """
    count = len(kinds)
    best, total = np.zeros(count, np.uint8), 0.0
    for low in range(0, count, 8192):
        high = min(low + 8192, count)
        part = slice(*np.searchsorted(words, [low, high]))
        seen = np.bincount((words[part] - low) * CLASSES + before[part], weights=times[part], minlength=(high - low) * CLASSES)
        logs = seen.reshape(-1, CLASSES) @ shares
        logs[np.arange(high - low), kinds[low:high]] += STAY
        logs[:, 0] = -np.inf
        best[low:high] = logs.argmax(axis=1)
        total += float(logs.max(axis=1).sum())
    return best, total


def _summed_table(found: DataFrame, choose) -> tuple[np.ndarray, float]:
    """Histories by classes, summed over all shards, for the classes that ``choose`` gives a shard's words; and its sum of logs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, logs = np.zeros((CLASSES, CLASSES), np.int64), 0.0
                if row["shard"] < 0:
                    table[:, 0] = unpack(row["times"], np.int64)
                else:
                    words, before, times = unpack_sorted(row["words"], np.int64), unpack(row["before"], np.uint8).astype(np.int64), unpack(row["times"], np.int64)
                    kinds, logs = choose(words, before, times, unpack(row["kinds"], np.uint8))
                    table = np.bincount(before * CLASSES + kinds[words], weights=times, minlength=CLASSES**2).astype(np.int64)
                table = table.ravel()
                here = np.flatnonzero(table)
                slots, n = np.append(here, -1), np.append(table[here], 0)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n), pa.array(np.where(slots < 0, logs, 0.0))], ["slot", "n", "logs"])

    rows = found.mapInArrow(measure, "slot long, n long, logs double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs")).collect()
    table, logs = np.zeros(CLASSES**2), 0.0  # one row per cell of the table
    for row in rows:
        if row["slot"] < 0:
            logs = row["logs"]
        else:
            table[row["slot"]] = row["n"]
    return table.reshape(CLASSES, CLASSES), logs


def cluster_vocabulary(found: DataFrame) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """From ``contexts``: the table of histories by classes, the log shares that choose each word's class, and the trace of
    the likelihood."""
    table, _ = _summed_table(found, lambda words, before, times, kinds: (kinds.astype(np.int64), 0.0))
    trace: list[float] = []
    while True:
        shares = _log_shares(table)
        shared = found.sparkSession.sparkContext.broadcast(shares)

        def choose(words, before, times, kinds, shared=shared):
            best, logs = _best_classes(words, before, times, kinds, shared.value)
            return best.astype(np.int64), logs

        table, logs = _summed_table(found, choose)
        trace.append(logs)
        if len(trace) > 1 and trace[-1] - trace[-2] <= GROWTH * abs(trace[-1]):
            return table, shares, trace


def with_classes(vocabulary: DataFrame, found: DataFrame, shares: np.ndarray) -> DataFrame:
    """``vocabulary`` with ``classes``, one byte for each word."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(shares)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for row in batch.to_pylist():
                words, before, times = unpack_sorted(row["words"], np.int64), unpack(row["before"], np.uint8).astype(np.int64), unpack(row["times"], np.int64)
                cells.append(pack(_best_classes(words, before, times, unpack(row["kinds"], np.uint8), shared.value)[0]))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(cells, pa.binary())], ["shard", "classes"])

    named = found.where("shard >= 0").mapInArrow(name, "shard int, classes binary")
    return materialize(vocabulary.join(named, "shard"), "word-classes")


class ClassModel:
    """Types, history classes, and all prices that do not depend on a rare word's count and class."""

    def __init__(self, types: Types, histories: np.ndarray, frequent: np.ndarray, table: np.ndarray, tokens: np.ndarray, words: np.ndarray, ends: int):
        self.types, self.histories, self.frequent_classes, self.ends = types, histories, frequent, ends
        share = (table.sum(axis=0) + 1) / (table.sum() + CLASSES)
        self.step = np.log10((table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))
        tokens, words = tokens.copy(), words.copy()
        tokens[0], words[0] = ends, ends > 0
        self.emission = np.log10(tokens + ADDED * (words + 1))
        self.frequent = np.log10(types.counts + ADDED)
        self.train_tokens = int(tokens.sum())
        self.base = np.log10(self.train_tokens + ADDED * (words.sum() + 1))


def _frequent_classes(named: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Classes of the frequent words: as many rows as there are such words."""
    shared = named.sparkSession.sparkContext.broadcast(keys)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                here, classes = unpack_sorted(row["keys"], np.uint64), unpack(row["classes"], np.uint8)
                _, mine, theirs = np.intersect1d(here, shared.value, assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(theirs.astype(np.int64)), pa.array(classes[mine].astype(np.int64))], ["place", "class"])

    found = named.select("keys", "classes").mapInArrow(pick, "place long, class long").toArrow()
    result = np.ones(len(keys), np.int64)
    result[found["place"].to_numpy()] = found["class"].to_numpy()
    return result


def learn(train: DataFrame, vocabulary: DataFrame, shards: int, text: str = "text") -> tuple[ClassModel, DataFrame]:
    """A model of the texts of ``train``, whose words ``vocabulary`` has counted; and the vocabulary with its classes."""
    spark = train.sparkSession
    keys, counts = _frequent(vocabulary)
    own = np.sort(keys[np.lexsort((keys, -counts))[:WORD_TYPES]])

    def ending(found: np.ndarray) -> np.ndarray:
        return np.where(np.isin(found, own), 1 << 16, (found & _LOW).astype(np.int64))

    types = Types(keys, counts, _by_type(vocabulary, ending, (1 << 16) + 1)[0][:-1])
    histories = exchange_classes(_neighbours(train, spark.sparkContext.broadcast(types), text))
    # Types that never occur have classes too: those of unseen endings.
    found = contexts(train, vocabulary, spark.sparkContext.broadcast((types, histories)), shards, text)
    table, shares, _ = cluster_vocabulary(found)
    named = with_classes(vocabulary, found, shares)
    tokens, words = _per_class(named)
    return ClassModel(types, histories, _frequent_classes(named, keys), table, tokens, words, train.count()), named


def _per_class(named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words per class."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                classes = unpack(row["classes"], np.uint8).astype(np.int64)
                tokens = np.bincount(classes, weights=unpack(row["counts"], np.int64), minlength=CLASSES).astype(np.int64)
                words = np.bincount(classes, minlength=CLASSES)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(words)], ["g", "tokens", "words"])

    found = named.select("counts", "classes").mapInArrow(measure, "g long, tokens long, words long")
    found = found.groupBy("g").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    tokens[found["g"].to_numpy()], words[found["g"].to_numpy()] = found["tokens"].to_numpy(), found["words"].to_numpy()
    return tokens, words


CELLS = (
    "shard int, batch long, kind int, doc_id long, place int, n long, known long, base double, score double, "
    "names binary, keys binary, before binary, times binary, prices binary"
)


def score(docs: DataFrame, named: DataFrame, model: ClassModel, shards: int, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row; ``named`` is the vocabulary with classes, in ``shards``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema(
        [("shard", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int32()), ("n", pa.int64()),
         ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("names", pa.binary()), ("keys", pa.binary()), ("before", pa.binary()),
         ("times", pa.binary()), ("prices", pa.binary())]
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for number, steps in _numbered(batches, text):
            rows, names, keys, before, times, place = [], [], [], [], [], 0
            for step in steps:
                words = Words(step.column(text))
                found = word_keys(words)
                frequent, kinds = m.types.find(found)
                previous, token, owner = _sequences(kinds, words)
                previous = m.histories[previous]
                is_word = token != END
                ends = np.bincount(owner[~is_word], weights=m.step[previous[~is_word], 0], minlength=words.texts) - m.emission[0]
                previous, common = previous[is_word], frequent >= 0
                own = m.frequent_classes[frequent[common]]
                prices = m.step[previous[common], own] - m.emission[own] + m.frequent[frequent[common]]
                priced = ends + np.log10(m.ends + ADDED) + np.bincount(words.owner[common], weights=prices, minlength=words.texts)
                counted = np.bincount(words.owner[common], weights=m.frequent[frequent[common]], minlength=words.texts) + np.log10(m.ends + ADDED)
                known = np.bincount(words.owner[common], minlength=words.texts) + (m.ends > 0)
                for k, doc_id in enumerate(step.column("doc_id").to_pylist()):
                    row = {"shard": dealt(number, shards), "batch": number, "kind": DOCUMENT, "doc_id": doc_id, "place": place + k, "n": int(words.counts[k]) + 1}
                    rows.append(row | {"known": int(known[k]), "base": counted[k], "score": priced[k]})
                # A word of a text, by what it follows.
                code = words.owner[~common].astype(np.int64) * CLASSES + previous[~common]
                rare = Groups(code, found[~common])
                names.append((place + rare.owner // CLASSES).astype(np.uint32))
                before.append((rare.owner % CLASSES).astype(np.uint8))
                keys.append(rare.values)
                times.append(rare.sizes.astype(np.uint32))
                place += words.texts
            names, keys, before, times = (np.concatenate(x) for x in (names, keys, before, times))
            order = np.argsort(keys, kind="stable")
            names, keys, before, times = names[order], keys[order], before[order], times[order]
            cuts = _shards(keys, shards)
            for k in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[k], cuts[k + 1])
                cell = {"names": pack(names[part]), "keys": pack_sorted(keys[part]), "before": pack(before[part]), "times": pack(times[part])}
                rows.append({"shard": int(k), "batch": number, "kind": ENTRIES} | cell)
            yield pa.RecordBatch.from_pylist(rows, schema)

    def price(cells: pa.Table, vocabulary_: pa.Table) -> pa.Table:
        """A shard: documents pass; a batch's words go back as sums per document."""
        m = shared.value
        keys, counts, classes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if vocabulary_.num_rows:
            keys, counts, classes = (f(vocabulary_[c][0].as_py(), t) for f, c, t in ((unpack_sorted, "keys", np.uint64), (unpack, "counts", np.int64), (unpack, "classes", np.uint8)))
        kinds = cells["kind"].to_numpy()
        back = []
        entries = cells.filter(pa.array(kinds == ENTRIES))
        for batch, names, wanted, before, times in zip(*(entries[c].to_pylist() for c in ("batch", "names", "keys", "before", "times"))):
            names, wanted, before, times = unpack(names, np.uint32), unpack_sorted(wanted, np.uint64), unpack(before, np.uint8), unpack(times, np.uint32)
            place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            seen = keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)
            count = np.where(seen, counts[place], 0) if len(keys) else np.zeros(len(wanted), np.int64)
            # A word that was not seen has the class of its ending.
            kind = m.histories[m.types.find(wanted)[1]]
            if len(keys):
                kind = np.where(seen, classes[place], kind)
            who, slot = np.unique(names, return_inverse=True)
            logs = np.log10(count + ADDED)
            sums = np.bincount(slot, weights=times * logs)
            prices = np.bincount(slot, weights=times * (logs + m.step[before, kind] - m.emission[kind]))
            known = np.bincount(slot, weights=times * (count > 0)).astype(np.int64)
            back.append({"batch": batch, "kind": PRICED, "names": pack(who), "keys": pack(sums), "times": pack(known), "prices": pack(prices)})
        return pa.concat_tables([cells.filter(pa.array(kinds != ENTRIES)).select(schema.names), pa.Table.from_pylist(back, schema)])

    def gather(cells: pa.Table) -> pa.Table:
        """A batch: each document's own part and the sums of all shards."""
        kinds = cells["kind"].to_numpy()
        rows = cells.filter(pa.array(kinds == DOCUMENT)).sort_by("place")
        base, priced, known = (rows[c].to_numpy().copy() for c in ("base", "score", "known"))
        for who, sums, prices, times in zip(*(cells.filter(pa.array(kinds == PRICED))[c].to_pylist() for c in ("names", "keys", "prices", "times"))):
            who = unpack(who, np.uint32)
            base[who] += unpack(sums, np.float64)
            priced[who] += unpack(prices, np.float64)
            known[who] += unpack(times, np.int64)
        return pa.table({"doc_id": rows["doc_id"], "n_tokens": rows["n"], "n_known": known, "base_score": base - rows["n"].to_numpy() * model_base, "score": priced})

    model_base = model.base
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(send, CELLS)
    priced = sent.groupBy("shard").cogroup(named.select("shard", "keys", "counts", "classes").groupBy("shard")).applyInArrow(lambda a, b: price(a, b), CELLS)
    return priced.groupBy("batch").applyInArrow(lambda t: gather(t), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, held_out: Column, text: str = "text") -> tuple[DataFrame, ClassModel]:
    """Scores of all ``docs``, learned from those where ``held_out`` does not hold; and the model."""
    train = docs.where(~held_out)
    shards = shard_count(text_bytes(docs, text), SHARD_BYTES)
    vocabulary = count_words(train, shards, text)
    model, named = learn(train, vocabulary, shards, text)
    return score(docs, named, model, shards, text), model
