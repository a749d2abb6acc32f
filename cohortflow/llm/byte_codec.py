"""Byte-level BPE encoding and decoding by overlapping chunks.

1. A text is cut into chunks of ``CHUNK`` characters, each read ``OVERLAP`` characters into the next one. The chunks of
   all texts are dealt out and pre-tokenised on their own: where each match of the pattern ends.
2. Stitching: a chunk that starts within a match may begin with wrong ends. As soon as one of its ends is also an end of
   the chunk before, both are at the same place of the same text, and matches depend only on what follows. From the
   first common end on, the later chunk counts; up to there the earlier one. An end near the cut of a chunk is not
   trusted, as the match could go on.
3. The pieces are encoded, each distinct piece of a step once, and the ids of a text are put together by chunk.

A text of one chunk needs no stitching and is encoded where it is read. A text with a border that no common end is found
at (one match longer than the overlap) is pre-tokenised as a whole. Pieces of over ``LONG`` bytes are merged here, with a
queue of pairs instead of a search through all of them. Decoding concatenates the bytes of the tokens.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens in a text are ordinary text;
an id outside the vocabulary is an error; equal texts get equal ids; other columns pass through whatever their names; an
empty table gives an empty result. The pattern has to match every character. Characters that the two pattern libraries
class differently (they know different versions of Unicode) count as what tiktoken takes them for.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import text_steps, with_text
from cohortflow.llm.piece_codec import _ranges
from cohortflow.session import materialize

#: Characters per chunk and of the next one that are read as well; a match that ends closer to a cut may go on.
CHUNK, OVERLAP, UNSURE = 1 << 16, 1 << 10, 2
#: Bytes of text and ids per step, bytes of a piece that is merged here.
STEP, IDS, LONG = 2 << 20, 1 << 19, 2048
#: Classes that a pattern can name, each with a character of it; the last one is in none of them.
CLASSES, NO_CLASS = {r"\p{L}": "a", r"\p{N}": "1", r"\s": " "}, "."


@functools.cache
def stand_ins() -> dict[int, str]:
    """A character of the class that tiktoken has it in for each one that the regex library classes differently."""
    import regex
    import tiktoken

    characters = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    theirs, ours = {}, {}
    for name, stand_in in CLASSES.items():
        # Only matches are encoded, so the bytes that come back are the members of the class.
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs |= dict.fromkeys(bytes(probe.encode_ordinary(characters)).decode(), stand_in)
        ours |= dict.fromkeys(regex.findall(name, characters), stand_in)
    return {ord(c): theirs.get(c, NO_CLASS) for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of lowest rank is merged until none is left."""
    size, longest = len(piece), max(map(len, ranks))
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))

    def pair(at: int) -> tuple[int, int, int] | None:
        middle = after[at]
        if middle >= size or after[middle] - at > longest:
            return None
        rank = ranks.get(piece[at : after[middle]])
        return None if rank is None else (rank, at, after[middle])

    queue = [p for p in map(pair, range(size)) if p]
    heapq.heapify(queue)
    while queue:
        found = heapq.heappop(queue)
        at = found[1]
        if after[at] < 0 or pair(at) != found:
            continue
        middle, stop = after[at], found[2]
        after[at], after[middle] = stop, -1
        if stop < size:
            before[stop] = at
        for changed in (at, before[at]):
            if changed >= 0 and (new := pair(changed)):
                heapq.heappush(queue, new)
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}


class Codec:
    """Pattern and ranks; the ids of many pieces at once as flat arrays."""

    def __init__(self, rank_file: bytes, pattern: str, differing: dict[int, str] | None = None):
        import regex
        import tiktoken

        self.ranks = read_ranks(rank_file)
        self.pattern = regex.compile(pattern)
        self.stand_ins = stand_ins() if differing is None else differing
        self.differing = np.zeros(0x110000, bool)
        self.differing[list(self.stand_ins)] = True
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.differing[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.pattern.findall(text)
        ends = np.cumsum([len(p) for p in self.pattern.findall(text.translate(self.stand_ins))])
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def _piece(self, piece: str) -> list[int]:
        # A match alone is matched as one again, so the library merges it as a whole.
        return self.encoding.encode_ordinary(piece) if len(piece) <= LONG // 4 else merge_long(piece.encode(), self.ranks)

    def encode(self, pieces: list[str], per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of texts that have ``per_text`` of the pieces each."""
        found = pa.array(pieces, pa.large_string()).dictionary_encode()
        lists = [self._piece(p) for p in found.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for one in lists for i in one), np.int32, int(sizes.sum()))
        entry = found.indices.to_numpy(zero_copy_only=False)
        flat = ids[_ranges((np.cumsum(sizes) - sizes)[entry], sizes[entry])]
        ends = np.concatenate([[0], np.cumsum(sizes[entry])])
        return flat, ends[np.concatenate([[0], np.cumsum(per_text)])]


class Tokens:
    """The bytes of each id."""

    def __init__(self, rank_file: bytes):
        self.bytes = {rank: token for token, rank in read_ranks(rank_file).items()}

    def decode(self, ids: list[int]) -> bytes:
        try:
            return b"".join(map(self.bytes.__getitem__, ids))
        except KeyError as missing:
            raise ValueError(f"id {missing} is not in the vocabulary") from None


_kept: dict[type, tuple[tuple, object]] = {}


def _once(kind: type, given: tuple):
    """One codec or token table per worker process."""
    if kind not in _kept or _kept[kind][0] != given:
        _kept[kind] = (given, kind(*given))
    return _kept[kind][1]


def _share(docs: DataFrame, rank_path: str, *more):
    """The rank file is read by the driver and travels as a broadcast of its size."""
    with open(rank_path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast((file.read(), *more))


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _whole(shared, name: str):
    """Encodes texts that are read whole; passes column ``name`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _once(Codec, shared.value)
        for batch in text_steps(batches, "_text", STEP):
            split = [codec.split(t) if t else [] for t in batch.column("_text").to_pylist()]
            flat, offsets = codec.encode([p for pieces in split for p in pieces], np.array([len(s) for s in split], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(name), _lists(flat, offsets)], [name, "token_ids"])

    return run


def cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, k, chunks, text): the overlapping chunks of ``texts`` (key, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("_text").to_pylist()):
                count = -(-len(text) // chunk)
                for k in range(count):
                    part = text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "chunks": count, "text": part}], schema)

    schema = pa.schema([("key", pa.int64()), ("k", pa.int32()), ("chunks", pa.int32()), ("text", pa.string())])
    return texts.mapInArrow(run, "key long, k int, chunks int, text string")


def match_ends(codec: Codec, text: str, last: bool) -> np.ndarray:
    """Where the matches of a chunk end, without those that a cut may have ended."""
    pieces = codec.split(text)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    if len(text) != (ends[-1] if len(ends) else 0):
        raise ValueError("the pattern does not match every character")
    return ends if last else ends[ends + UNSURE <= len(text)]


def _pretokenised(chunks: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """``chunks`` with the ends of their matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _once(Codec, shared.value)
        for batch in batches:
            texts, places, counts = (batch.column(c).to_pylist() for c in ("text", "k", "chunks"))
            # A chunk that the text ends in is not cut; only the last two can be such.
            ends = [match_ends(codec, t, k == n - 1 or len(t) < chunk + overlap) for t, k, n in zip(texts, places, counts)]
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(np.concatenate(ends), offsets)], [*batch.schema.names, "ends"])

    return chunks.mapInArrow(run, "key long, k int, chunks int, text string, ends array<int>")


def borders(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, k, sync): the first end, counted from the start of chunk k, that chunk k - 1 has as well; null if there is none."""
    tails = chunks.where("k < chunks - 1").select(
        "key", (F.col("k") + 1).alias("k"), F.transform(F.filter("ends", lambda e: e >= chunk), lambda e: e - chunk).alias("tail")
    )
    # The start of a chunk is an end if the chunk before has one there.
    heads = chunks.where("k > 0").select("key", "k", F.concat(F.array(F.lit(0)), F.filter("ends", lambda e: e <= overlap)).alias("head"))
    return tails.join(heads, ["key", "k"]).select("key", "k", F.array_min(F.array_intersect("tail", "head")).alias("sync"))


def _encode_owned(owned: DataFrame, shared) -> DataFrame:
    """(key, k, ids) of the matches of each chunk between ``start`` and ``stop``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _once(Codec, shared.value)
        for batch in batches:
            pieces, per_chunk = [], []
            for text, ends, start, stop in zip(*(batch.column(c).to_pylist() for c in ("text", "ends", "start", "stop"))):
                own = [start] + [e for e in ends if start < e <= stop]
                pieces += [text[a:b] for a, b in zip(own, own[1:])]
                per_chunk.append(len(own) - 1)
            flat, offsets = codec.encode(pieces, np.array(per_chunk, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), _lists(flat, offsets)], ["key", "k", "ids"])

    return owned.select("key", "k", "text", "ends", "start", "stop").mapInArrow(run, "key long, k int, ids array<int>")


def _stitched(texts: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """(key, token_ids) for ``texts`` (key, _text) of more than one chunk."""
    chunks = materialize(_pretokenised(cut(texts, chunk, overlap).repartition("key", "k"), shared, chunk, overlap), "bpe-chunks")
    syncs = materialize(borders(chunks, chunk, overlap), "bpe-borders")
    broken = syncs.where("sync IS NULL").select("key").distinct()
    starts = syncs.select("key", "k", F.col("sync").alias("from"))
    stops = syncs.select("key", (F.col("k") - 1).alias("k"), (F.col("sync") + chunk).alias("to"))
    whole = F.length("text")
    owned = (
        chunks.join(broken, "key", "left_anti")
        .join(starts, ["key", "k"], "left")
        .join(stops, ["key", "k"], "left")
        .select("key", "k", "text", "ends", F.coalesce("from", F.lit(0)).alias("start"), F.coalesce("to", whole).alias("stop"))
    )
    parts = _encode_owned(owned, shared).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    met = parts.select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"))
    unmet = texts.join(broken, "key", "left_semi").mapInArrow(_whole(shared, "key"), "key long, token_ids array<int>")
    return met.unionByName(unmet)


def encode(
    docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """The columns to keep (all by default) as struct ``row`` with ``token_ids``."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be within the next chunk")
    shared = _share(docs, rank_path, pattern, stand_ins())
    packed, row = with_text(docs, text, keep)
    size = F.length("_text")
    short = packed.where(size.isNull() | (size <= chunk)).mapInArrow(_whole(shared, "row"), f"row {row}, token_ids array<int>")
    # Keys are written, so that they stay when a task is repeated.
    long = materialize(packed.where(size > chunk).withColumn("key", F.monotonically_increasing_id()), "bpe-long")
    stitched = _stitched(long.select("key", "_text"), shared, chunk, overlap)
    return short.unionByName(long.select("key", "row").join(stitched, "key").select("row", "token_ids"))


def decode(tokens: DataFrame, rank_path: str, ids: str = "token_ids") -> DataFrame:
    """``tokens`` as struct ``row`` with ``decoded``, the bytes of the ids; null ids decode to no bytes."""
    shared = _share(tokens, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _once(Tokens, shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("_ids")), 0).to_numpy(zero_copy_only=False)
            step = np.cumsum(sizes) // IDS
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(sizes)]
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                flat, ends = part.column("_ids").flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes[low:high])
                decoded = [table.decode(flat[a:b].tolist()) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(decoded, pa.binary())], ["row", "decoded"])

    packed = tokens.select(F.struct("*").alias("row"), F.col(ids).alias("_ids"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, decoded binary")


def ids_text(ids: Column) -> Column:
    """Decimal ids, joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
