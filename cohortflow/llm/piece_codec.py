"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as protobuf wire format and rebuilt: normaliser (its compiled character map, if any, white
space rules, the meta space as word marker), the pieces with their scores (a unigram model as it is; for a BPE model
the scores give the order of merges) and byte fallback. Where no piece holds a marker after another character, words
are independent, so each distinct word of a step is encoded once and texts are put together by look-up; a text with
neighbouring spaces is encoded whole. All that is encoded is also given to the sentencepiece library, and a text is
marked where the two differ.

Defined results: a null or empty text has no tokens and decodes to an empty text; special pieces in a text are
ordinary characters; bytes that are no character decode to U+FFFD; equal texts get equal results; other columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import text_steps, with_text

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text per step (words are told apart within it), words per library call, threads per task.
STEP, CALL, THREADS = 4 << 20, 4096, 2
MARK = "▁"
# Fixed values of the model format: field numbers, piece types, model types.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_MODEL_TYPE, _SUFFIX_MARK, _BYTE_FALLBACK, _UNKNOWN_SURFACE = 3, 24, 35, 44
_CHARSMAP, _DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE = 2, 3, 4, 5


def _wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; nested messages and strings stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None or at + size > len(data):
            raise ValueError("not a SentencePiece model")
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for field, value in _wire(data):
            if field == _PIECES:
                parts = dict(_wire(value))
                score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
                self.pieces.append((parts.get(1, b"").decode(), score, parts.get(3, NORMAL)))
            elif field == _TRAINER:
                trainer = dict(_wire(value))
            elif field == _NORMALIZER:
                normalizer = dict(_wire(value))
        self.kind = trainer.get(_MODEL_TYPE, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if trainer.get(_SUFFIX_MARK, 0) or not normalizer.get(_ESCAPE, 1):
            raise ValueError("the word marker must be an escaped prefix")
        self.byte_fallback = bool(trainer.get(_BYTE_FALLBACK, 0))
        self.unknown_surface = trainer.get(_UNKNOWN_SURFACE, " ⁇ ".encode())
        self.charsmap = normalizer.get(_CHARSMAP, b"")
        self.dummy_prefix = bool(normalizer.get(_DUMMY_PREFIX, 1))
        self.remove_spaces = bool(normalizer.get(_REMOVE_SPACES, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.words_independent = not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def rebuild(model: PieceModel):
    """A tokenizers.Tokenizer, without normaliser, that cuts marked text as the model does; and the normaliser."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    known = (NORMAL, USER)
    if model.kind == UNIGRAM:
        # Pieces that no text may match get a name that no text holds.
        rows = [(p if kind in known or kind == BYTE else f"\0{i}", score) for i, (p, score, kind) in enumerate(model.pieces)]
        backend = models.Unigram(rows, model.unknown, model.byte_fallback)
    else:
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p for p, _, kind in model.pieces if kind in known}
        merges = []
        for piece, score, kind in model.pieces:
            if kind in known:
                cuts = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
                merges += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in cuts if a in usable and b in usable]
        backend = models.BPE(
            vocab=ids,
            merges=[m[4:] for m in sorted(merges)],
            unk_token=model.pieces[model.unknown][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    return Tokenizer(backend), normalizers.Sequence(steps)


class Codec:
    """Encoder and decoder of many texts at once; ids are one flat array with offsets."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = PieceModel(data)
        self.tokenizer, self.normalizer = rebuild(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.plain = not self.model.charsmap and not self.model.remove_spaces and self.model.dummy_prefix
        surfaces = []
        for piece, _, kind in self.model.pieces:
            if kind == BYTE:
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                surfaces.append(b"")
            else:
                surfaces.append(self.model.unknown_surface if kind == UNKNOWN else piece.replace(MARK, " ").encode())
        self.surface_sizes = np.array([len(s) for s in surfaces])
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)

    def normal(self, text: str) -> str:
        return (MARK + text.replace(" ", MARK) if text else "") if self.plain else self.normalizer.normalize_str(text)

    def _calls(self, marked: list[str], plain: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, their number per string, and whether sentencepiece gives the same."""
        ids, sizes, same = [], [], []
        for low in range(0, len(marked), CALL):
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(marked[low : low + CALL], add_special_tokens=False)]
            theirs = self.peer.encode(plain[low : low + CALL], num_threads=self.threads)
            same += [a == b for a, b in zip(ours, theirs)]
            sizes += map(len, ours)
            ids += [np.array(x, np.int32) for x in ours]
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(sizes, np.int64), np.array(same, bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, offsets per text, and whether all of a text agrees with sentencepiece."""
        normal = [self.normal(t) for t in texts]
        cut = [self.model.words_independent and n.startswith(MARK) and MARK * 2 not in n and not n.endswith(MARK) for n in normal]
        # One look-up table of distinct strings: words of texts that are cut, and whole texts that are not.
        words = pc.split_pattern(pa.array([n[1:] for n, c in zip(normal, cut) if c], pa.large_string()), MARK)
        found = words.flatten().dictionary_encode()
        whole = [i for i, c in enumerate(cut) if not c]
        known = found.dictionary.to_pylist()
        ids, sizes, same = self._calls([MARK + w for w in known] + [normal[i] for i in whole], known + [texts[i] for i in whole])
        starts = np.cumsum(sizes) - sizes
        per_text = np.ones(len(texts), np.int64)
        per_text[np.flatnonzero(cut)] = pc.list_value_length(words).to_numpy(zero_copy_only=False) if any(cut) else 0
        entry = np.empty(int(per_text.sum()), np.int64)
        owner = np.repeat(np.arange(len(texts)), per_text)
        is_word = np.array(cut, bool)[owner] if len(owner) else np.zeros(0, bool)
        entry[is_word] = found.indices.to_numpy(zero_copy_only=False)
        entry[~is_word] = len(known) + np.arange(len(whole))
        flat = ids[_ranges(starts[entry], sizes[entry])]
        tokens = np.bincount(owner, weights=sizes[entry], minlength=len(texts)).astype(np.int64)
        agrees = np.bincount(owner, weights=~same[entry], minlength=len(texts)) == 0
        return flat, np.concatenate([[0], np.cumsum(tokens)]), agrees

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of the stretches of ``ids`` between ``offsets``."""
        sizes = self.surface_sizes[ids]
        data = self.surfaces[_ranges(self.surface_starts[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        strip = 1 if self.model.dummy_prefix else 0
        texts = [data[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:])]
        return [t[1:] if strip and t.startswith(" ") else t for t in texts]

    def readable(self, text: str) -> str:
        """What decoding gives back for ``text``: its normal form."""
        if self.plain:
            return text.replace(MARK, " ")
        normal = self.normal(text).replace(MARK, " ")
        return normal[1:] if self.model.dummy_prefix and normal.startswith(" ") else normal


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


_codecs: dict[bytes, Codec] = {}


def _codec(data: bytes) -> Codec:
    """One codec per worker process: rebuilding takes longer than a batch."""
    if data not in _codecs:
        _codecs.clear()
        _codecs[data] = Codec(data)
    return _codecs[data]


def encode(docs: DataFrame, model_path: str = MODEL_PATH, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) as struct ``row`` with token_ids, n_tokens, round_trip (decodes to its normal form) and parity.

    The driver reads the model file; it travels as a broadcast of its size, so executors need no file.
    """
    packed, row = with_text(docs, text, keep)
    with open(model_path, "rb") as file:
        data = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in text_steps(batches, "_text", STEP):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            ids, offsets, agrees = codec.encode(texts)
            back = [a == codec.readable(b) for a, b in zip(codec.decode(ids, offsets), texts)]
            columns = [
                batch.column("row"),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                pa.array(np.diff(offsets)),
                pa.array(back),
                pa.array(agrees),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "token_ids", "n_tokens", "round_trip", "parity"])

    schema = f"row {row}, token_ids array<int>, n_tokens long, round_trip boolean, parity boolean"
    return packed.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str = MODEL_PATH, ids: str = "token_ids") -> DataFrame:
    """``tokens`` as struct ``row`` with ``decoded``; null ids decode to an empty text."""
    with open(model_path, "rb") as file:
        shared = tokens.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            lists = batch.column("_ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "decoded"])

    packed = tokens.select(F.struct("*").alias("row"), F.col(ids).alias("_ids"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, decoded string")
